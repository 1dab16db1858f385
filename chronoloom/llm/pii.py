"""Personal data: pattern spans, then information-theoretic sanitisation.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers.
Each value found is a protected entity. From all documents it is counted how
often a term stands near an entity and how often either occurs at all. A term t
discloses an entity e by

    PMI(e; t) / IC(e)  with  PMI = ln(n_et * N / (n_e * n_t)),  IC = ln(N / n_e)

where counts are of documents; 1 means that the term gives the entity away, 0
that it tells nothing. Terms at or above ``threshold`` become spans of kind
``term`` wherever they stand near that entity. An entity may be in one text
only; then the term's frequency in the corpus decides, as the share is
1 - ln(n_t) / ln(N). Terms are runs of letters of any length. Redaction removes
base spans and generalises terms, each to a placeholder.

The disclosing pairs are counted. Up to ``broadcast_rows`` of them go to every
task; more of them are joined to the documents by document and text.

Null text counts as empty: no spans, redacted to null. Repeated rows get equal
spans, and count as often as they occur. Very long texts are read whole. Of two
entities that disclose one term's place the smaller number is named. Offsets are
code points, ends exclusive. Spans of a kind don't overlap; spans of different
kinds may, and redaction merges those. Other columns are carried along whatever
their names, but for one with the name of ``out``, which is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.shared import arrow_function, stored, unused

KINDS = ("email", "ip", "card", "phone")
#: Words of three letters or more on either side of a base span that may disclose it, with the shorter ones among them.
CONTEXT_WORDS = 8
THRESHOLD, BROADCAST_ROWS = 0.9, 200_000

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_not_digit = re.compile(r"[^0-9]")
_term = re.compile(r"[^\W\d_]+")

SPAN = "struct<kind:string,start:int,end:int,entity:bigint>"
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("entity", pa.int64())]))
PAIR = "struct<entity:bigint,term:string>"
PAIR_ARROW = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string())]))


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[::-2]]
    even = [2 * int(d) for d in digits[-2::-2]]
    return (sum(odd) + sum(d - 9 * (d > 9) for d in even)) % 10 == 0


def _entity(kind: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}:{value}") - (1 << 63)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping addresses. From each @ the local part is read leftwards and the domain rightwards, so a long run of letters costs its length once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(free, at + 1))


def base_spans(text: str | None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, entity), by kind as listed, then start."""
    if not text:
        return []
    out = []
    if "@" in text:
        out += [("email", a, b, _entity("email", text[a:b].lower())) for a, b in emails(text)]
    out += [("ip", m.start(), m.end(), _entity("ip", m[0])) for m in _ip.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _card.finditer(text):
        if len(m[0]) >= 16 and 16 <= len(digits := _not_digit.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end(), _entity("card", digits)))
    if "+" in text:
        for m in _phone.finditer(text):
            if 8 <= len(digits := _not_digit.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end(), _entity("phone", digits)))
    return out


def _merged(spans: list[tuple[str, int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans' union."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b, _ in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _touches(union: tuple[list[int], list[int]], start: int, end: int) -> bool:
    k = bisect_left(union[0], end) - 1
    return k >= 0 and union[1][k] > start


def near(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Terms (lower case, start, end) among the words around a span: up to the eighth long word on either side, however far it is."""

    def before() -> Iterator[tuple[int, int]]:
        stop, width = start, 512
        while stop > 0:
            low = max(0, stop - width)
            words = [m.span() for m in _term.finditer(text, low, stop)]
            if words and words[0][0] == low > 0:  # it may begin further left
                del words[0]
            yield from reversed(words)
            if words:
                stop, width = words[0][0], 512
            elif low == 0:
                return
            else:  # no whole word so far
                width *= 2

    for spans in (before(), (m.span() for m in _term.finditer(text, end))):
        long = 0
        for a, b in spans:
            yield text[a:b].lower(), a, b
            long += b - a >= 3
            if long == CONTEXT_WORDS:
                break


def context_pairs(text: str | None) -> set[tuple[int, str | None]]:
    """Each entity of the text alone (no term) and with each term near it."""
    out: set[tuple[int, str | None]] = set()
    spans = base_spans(text)
    union = _merged(spans)
    for _, a, b, entity in spans:
        out.add((entity, None))
        out.update((entity, term) for term, c, d in near(text, a, b) if not _touches(union, c, d))
    return out


@arrow_function(f"array<{PAIR}>")
def pairs_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([[{"entity": e, "term": t} for e, t in sorted(context_pairs(x.as_py()), key=lambda p: (p[0], p[1] or ""))] for x in texts], PAIR_ARROW)


def _term_counts(wanted: frozenset[str] | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"term": list(held), "n": list(held.values())}, pa.schema([("term", pa.string()), ("n", pa.int64())]))
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                own = {w.lower() for w in set(_term.findall(text.as_py() or ""))}
                held.update(own if wanted is None else own & wanted)
                if len(held) > 500_000:
                    yield flushed()
        yield flushed()

    return count


def disclosures(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs (entity, term, disclosure) at or above the threshold, from counts over all documents."""
    spark = docs.sparkSession
    near_by = docs.select(F.explode(pairs_of(F.col(text))).alias("p")).select("p.entity", "p.term")
    counts = stored(near_by.groupBy("entity", "term").agg(F.count("*").alias("n")), "pii-counts")
    joint = counts.where(F.col("term").isNotNull())
    terms = joint.select("term").distinct()
    first = [r["term"] for r in terms.limit(broadcast_rows + 1).toLocalIterator()]
    wanted = frozenset(first) if len(first) <= broadcast_rows else None
    if not first:
        return spark.createDataFrame([], "entity bigint, term string, disclosure double")
    n_docs = docs.count()
    # written, so that adaptive execution may split the join at a common term
    n_term = stored(docs.select(text).mapInArrow(_term_counts(wanted), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n_term")), "pii-terms")
    n_entity = counts.where("term is null").select("entity", F.col("n").alias("n_entity"))
    share = F.log(F.col("n") * n_docs / (F.col("n_entity") * F.col("n_term"))) / F.log(n_docs / F.col("n_entity"))
    found = joint.join(n_term, "term").join(n_entity, "entity").where(F.col("n_entity") < n_docs)
    return stored(found.select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= threshold), "pii-disclosures")


def _spans(text: str | None, telling: dict[int, frozenset[str]]) -> list[dict]:
    base = base_spans(text)
    union, found = _merged(base), set()
    for _, a, b, entity in base:
        if terms := telling.get(entity):
            found.update((c, d, entity) for term, c, d in near(text, a, b) if term in terms and not _touches(union, c, d))
    first: dict[tuple[int, int], int] = {}
    for c, d, entity in sorted(found):
        first.setdefault((c, d), entity)
    return [dict(zip(("kind", "start", "end", "entity"), x, strict=True)) for x in base + [("term", c, d, entity) for (c, d), entity in first.items()]]


def _grouped(rules: list[dict] | None) -> dict[int, frozenset[str]]:
    out: dict[int, set[str]] = {}
    for r in rules or ():
        out.setdefault(r["entity"], set()).add(r["term"])
    return {e: frozenset(t) for e, t in out.items()}


def with_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "pii", threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with all spans, base and term, as array<SPAN> in the column ``out``."""
    telling = disclosures(docs, text, threshold, broadcast_rows)
    first = telling.select("entity", "term").limit(broadcast_rows + 1).collect()
    if len(first) <= broadcast_rows:
        everywhere = docs.sparkSession.sparkContext.broadcast(_grouped([r.asDict() for r in first]))

        @F.arrow_udf(f"array<{SPAN}>")
        def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield pa.array([_spans(x.as_py(), everywhere.value) for x in texts], SPAN_ARROW)

        return docs.withColumn(out, spans(F.col(text)))

    @F.arrow_udf(f"array<{SPAN}>")
    def spans_by(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, rules in batches:
            yield pa.array([_spans(x.as_py(), _grouped(r.as_py())) for x, r in zip(texts, rules, strict=True)], SPAN_ARROW)

    k, h, r = unused(docs, "key", "hash", "rules")
    own = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.explode(pairs_of(F.col(text))).alias("p")).select("key", "hash", "p.entity", "p.term").distinct()
    rules = own.join(telling.select("entity", "term"), ["entity", "term"]).groupBy(F.col("key").alias(k), F.col("hash").alias(h)).agg(F.collect_list(F.struct("entity", "term")).alias(r))
    joined = docs.join(rules, docs[key].eqNullSafe(rules[k]) & (F.xxhash64(docs[text]) == rules[h]), "left")
    return joined.withColumn(out, spans_by(F.col(text), F.col(r))).drop(k, h, r)


@arrow_function("string")
def redacted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Text and its spans to the text with every span replaced by its kind; overlapping spans become one placeholder."""
    for texts, spans in batches:
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if text and own:
                parts, past = [], 0
                for s in sorted(own, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= past:
                        parts += [text[past : s["start"]], f"<{s['kind'].upper()}>"]
                    past = max(past, s["end"])
                text = "".join([*parts, text[past:]])
            out.append(text)
        yield pa.array(out, pa.string())


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with sanitised texts."""
    spans = unused(docs, "spans")[0]
    return with_spans(docs, key, text, spans).withColumn(text, redacted(F.col(text), F.col(spans))).drop(spans)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: key, n_email, n_ip, n_card, n_phone, n_term, has_pii (a base span was found), base_sha256, spans."""
    found = with_spans(docs.select(key, text), key, text).select(key, "pii")
    base = F.filter("pii", lambda s: s["kind"] != "term")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(key, *map(count, (*KINDS, "term")), (F.size(base) > 0).alias("has_pii"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"))

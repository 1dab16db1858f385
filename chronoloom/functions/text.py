"""Column functions on text and on parsed literals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_clock(t: Column) -> Column:
    """HH:MM:SS, MM:SS or SS as seconds, fractions cut off; null if malformed."""
    parts = F.reverse(F.split(F.trim(t), ":"))
    number = lambda k: F.coalesce(F.floor(F.try_element_at(parts, F.lit(k)).try_cast("double")), F.when(F.size(parts) < k, 0))
    return F.when(F.size(parts) <= 3, number(1) + 60 * number(2) + 3600 * number(3)).cast("long")


def parse_spans(text: Column) -> Column:
    """Number pairs in brackets as array<struct<start, end>>, reversed ones swapped."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?)"
    pattern = rf"\[\s*{number}\s*,\s*{number}\s*\]"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b"))
    return F.transform(pairs, lambda p: F.struct(F.least(p["a"].cast("double"), p["b"].cast("double")).alias("start"), F.greatest(p["a"].cast("double"), p["b"].cast("double")).alias("end")))


def parse_pairs(text: Column) -> Column:
    """Number pairs in round brackets as array<struct<start, end>>, in the order of the text; without any, the one pair of a text that is a pair in square brackets and nothing else."""
    pair = r"\s*([0-9]+(?:\.[0-9]+)?)\s*,\s*([0-9]+(?:\.[0-9]+)?)\s*"
    own = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))

    def found(pattern: str) -> Column:
        sides = [F.regexp_extract_all(own, F.lit(pattern), F.lit(k)) for k in (1, 2)]
        return F.zip_with(*sides, lambda a, b: F.struct(a.cast("double").alias("start"), b.cast("double").alias("end")))

    return F.when(F.regexp_like(own, F.lit(rf"\({pair}\)")), found(rf"\({pair}\)")).otherwise(found(rf"^\[{pair}\]$"))


def norm_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}']+"), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def count_matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def clauses(text: Column) -> Column:
    """Stretches that end after a full stop, a comma or a bar, without blanks around; none empty."""
    marked = F.regexp_replace(F.regexp_replace(text, "\n", " "), "([。，.,])", "$1|")
    return F.filter(F.transform(F.split(marked, r"\|"), lambda c: F.btrim(c, F.lit(" \t\r\x0b\x0c"))), lambda c: c != "")


#: Marks and words of captions without speech.
TAGS = ("[", "(", "♪", "《音", "音乐", "掌声", "Music", "music", "Applause", "字幕", "订阅", "点赞")


def degeneracy(text: Column) -> Column:
    """Struct: n_clauses, loop_frac (share of the clauses' characters in clauses that occur again; null under two clauses), max_char_run, distinct_char_ratio (null for an empty text), bracket_tag."""
    t = F.coalesce(text, F.lit(""))
    length = lambda cs: F.aggregate(cs, F.lit(0), lambda a, c: a + F.length(c))
    again = lambda cs: F.filter(cs, lambda c, k: F.coalesce(c == F.get(cs, k - 1), F.lit(False)) | F.coalesce(c == F.get(cs, k + 1), F.lit(False)))
    runs = F.transform(F.regexp_extract_all(t, F.lit(r"(?s)(.)\1+"), F.lit(0)), lambda r: F.length(r))
    return F.transform(F.array(F.array_sort(clauses(t))), lambda cs: F.struct(
        F.size(cs).alias("n_clauses"),
        F.when(F.size(cs) >= 2, length(again(cs)) / F.greatest(length(cs), F.lit(1))).alias("loop_frac"),
        F.coalesce(F.array_max(runs), (t != "").cast("int")).alias("max_char_run"),
        F.when(t != "", F.size(F.array_distinct(F.split(t, ""))) / F.length(t)).alias("distinct_char_ratio"),
        F.exists(F.array(*map(F.lit, TAGS)), lambda x: F.contains(t, x)).alias("bracket_tag"),
    ))[0]


def slice_by_share(ws: Column, a: Column, b: Column, start: Column, end: Column) -> Column:
    """Words of [start, end) that fall into [a, b), in proportion to time, both ends rounded half to even."""
    n, length = F.size(ws), end - start
    first = F.rint(n * (F.greatest(a, start) - start) / length).cast("int")
    last = F.rint(n * (F.least(b, end) - start) / length).cast("int")
    return F.slice(ws, first + 1, F.greatest(last - first, F.lit(0)))


def clipped_piece(text: Column, a: Column, b: Column, start: Column, end: Column) -> Column:
    """What of a segment [start, end) falls into [a, b), as struct (start, end, text) with times clipped: the text as it is if it lies inside, else its words in proportion to time; null if there is nothing."""
    lo, hi = F.greatest(start, a), F.least(end, b)
    own = words(text)
    cut = F.array_join(slice_by_share(own, a, b, start, end), " ")
    said = F.when((start >= a) & (end <= b), F.nullif(text, F.lit(""))).otherwise(F.nullif(cut, F.lit("")))
    return F.when((hi > lo) & said.isNotNull(), F.struct(lo.alias("start"), hi.alias("end"), said.alias("text")))


def label_prefix(text: Column, key: str = "label") -> Column:
    """Text up to and with a quoted key and its colon; null without it."""
    return F.nullif(F.regexp_extract(text, rf'(?s)^(.*?"{key}"\s*:\s*)', 1), F.lit(""))


def clean_json(text: Column) -> Column:
    """A text, without the json code fence around it if it has one, if it parses as JSON; else null."""
    own = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)^\s+|\s+$", ""))
    body = F.trim(F.when(own.startswith("```json") & own.endswith("```"), F.regexp_replace(own, r"(?s)^```json\s*|\s*```$", "")).otherwise(own))
    return F.when(F.try_parse_json(body).isNotNull(), body)


#: A number, and the phrases that name a score, tried in this order.
NUMBER = r"[-+]?\d*\.?\d+"
PHRASES = (
    rf"(?i)final\s+(?:anomaly\s+)?score\s+is\s*[:=]?\s*({NUMBER})",
    rf"(?i)(?:anomaly\s+)?score\s+is\s*[:=]?\s*({NUMBER})",
    rf"(?i)(?:final\s+)?(?:anomaly\s+)?score\s*[:=]\s*({NUMBER})",
)
_BARE = r"(?i)^[-+]?(?:(?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?|nan|inf|infinity)$"


def parse_score(text: Column) -> Column:
    """Struct (score, status) of an answer: a bare number, else the last number of the first phrase that occurs, else a number at the end. The score is as written."""
    own = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    last = [F.try_element_at(F.regexp_extract_all(own, F.lit(p), F.lit(1)), F.lit(-1)) for p in PHRASES]
    phrase, trailing = F.coalesce(*last), F.nullif(F.regexp_extract(own, rf"({NUMBER})\s*[.\s]*$", 1), F.lit(""))
    bare = own.rlike(_BARE)
    status = F.when(own == "", "empty").when(bare, "bare_float").when(phrase.isNotNull(), "sentence").when(trailing.isNotNull(), "trailing_number").otherwise("unparsed")
    return F.struct(F.when(bare, own).otherwise(F.coalesce(phrase, trailing)).try_cast("double").alias("score"), status.alias("status"))


def normalise_score(score: Column) -> Column:
    """Struct (value, rule): a score on a scale to 1, 10 or 100, whichever is the first that holds it, brought to [0, 1]."""
    finite = ~F.isnan(score) & (F.abs(score) != float("inf"))
    cases = [(score.isNull(), F.lit(None), "none"), (~finite, F.lit(None), "nonfinite"), (score < 0, F.lit(0.0), "clamped_low"), (score <= 1, score, "in_range"), (score <= 10, score / 10, "div10"), (score <= 100, score / 100, "div100")]
    value, rule = F.lit(1.0), F.lit("clamped_high")
    for on, then, name in reversed(cases):
        value, rule = F.when(on, then).otherwise(value), F.when(on, F.lit(name)).otherwise(rule)
    return F.struct(value.alias("value"), rule.alias("rule"))


def yes_no_logodds(logprobs: Column, empty: float = -1e4) -> Column:
    """Struct (z, status): log-sum-exp of the yes spellings less that of the no spellings in a map of log probabilities. A missing side is bounded by the least of the map, and the status says so."""
    def side(name: str) -> Column:
        own = F.map_values(F.map_filter(logprobs, lambda k, _: F.lower(F.trim(k)) == name))
        return F.when(F.size(own) > 0, F.array_max(own) + F.log(F.aggregate(own, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(own)))))

    bound = F.coalesce(F.array_min(F.map_values(logprobs)), F.lit(empty))
    yes, no = side("yes"), side("no")
    return F.struct((F.coalesce(yes, bound) - F.coalesce(no, bound)).alias("z"), F.when(yes.isNotNull() & no.isNotNull(), "ok").otherwise("bounded").alias("status"))


def _mean_digit(logprobs: Column, worth) -> Column:
    own = F.map_filter(logprobs, lambda k, _: k.rlike("^[0-9]$"))
    mass = F.aggregate(F.map_values(own), F.lit(0.0), lambda a, x: a + F.exp(x))
    total = F.aggregate(F.map_entries(own), F.lit(0.0), lambda a, e: a + worth(e["key"].cast("int")) * F.exp(e["value"]))
    return F.when(mass > 0, total / mass)


def expected_score(first: Column, decimal: Column) -> Column:
    """Mean score in [0, 1] under the log probabilities of its first digit and of the digit after "0."; a first digit of 2 or more counts tenths."""
    tenths = _mean_digit(decimal, lambda d: d / 10)
    return _mean_digit(first, lambda d: F.when(d == 0, tenths).when(d == 1, 1.0).otherwise(d / 10))


def rendered(segments: Column) -> Column:
    """A line for each (start, end, text)."""
    return F.array_join(F.transform(segments, lambda s: F.format_string("[%.1f-%.1f] %s", s["start"], s["end"], s["text"])), "\n")


def gzip_ratio(text: Column) -> Column:
    """Bytes of a text over those of its gzip form; null for an empty text."""
    @F.pandas_udf("double")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import gzip

        for texts in batches:
            raw = [(t or "").encode() for t in texts]
            yield pd.Series([len(r) / len(gzip.compress(r)) if r else None for r in raw], dtype="float64")

    return ratio(text)


def clause_key(text: Column) -> Column:
    """NFKC, case folded, punctuation and runs of blanks as one blank."""
    @F.pandas_udf("string")
    def key(texts: pd.Series) -> pd.Series:
        import re
        import unicodedata

        return texts.map(lambda t: None if t is None else " ".join(re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", t).casefold()).split()))

    return key(text)


def edits_and_common(x, y) -> tuple[int, int]:
    """Edit distance and longest common subsequence of two word lists, exact; a column of either table is held in the bits of whole numbers (Myers 1999, Hyyrö 2004)."""
    n = len(x)
    if not n:
        return len(y), 0
    places: dict[str, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n - 1
    up, down, edits, rest = full, 0, n, full
    for w in y:
        at = places.get(w, 0)
        here = at | down
        across = (((at & up) + up) ^ up) | at
        more, less = down | full & ~(across | up), up & across
        edits += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | full & ~(here | more), more & here
        hit = rest & at
        rest = (rest + hit | rest - hit) & full
    return edits, n - rest.bit_count()


def word_distance(a: Column, b: Column) -> Column:
    """Struct (edits, common): edit distance and longest common subsequence of two word lists."""
    @F.pandas_udf("struct<edits:int,common:int>")
    def distance(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([edits_and_common(x, y) for x, y in zip(left, right, strict=True)], columns=["edits", "common"])

    return distance(a, b)


def align_words(anchor: list[str], own: list[str]) -> tuple[list[str], list[str]]:
    """``own`` aligned to ``anchor`` by edit distance without regard to case: the word at each anchor word ("" if none), and the phrase at each of the boundaries. Of equal ways the diagonal goes first, then deletion."""
    n, m = len(anchor), len(own)
    code: dict[str, int] = {}
    left, right = (np.array([code.setdefault(w.casefold(), len(code)) for w in ws], dtype=np.int64) for ws in (anchor, own))
    steps = np.arange(m + 1)
    d = np.empty((n + 1, m + 1), dtype=np.int64)
    d[0] = steps
    for i in range(1, n + 1):
        row = d[i - 1] + 1
        row[1:] = np.minimum(row[1:], d[i - 1, :-1] + (right != left[i - 1]))
        d[i] = np.minimum.accumulate(row - steps) + steps
    values, phrases = [""] * n, [[] for _ in range(n + 1)]
    i, j = n, m
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + (left[i - 1] != right[j - 1]):
            i, j = i - 1, j - 1
            values[i] = own[j]
        elif i and d[i, j] == d[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
            phrases[i].append(own[j])
    return values, [" ".join(reversed(p)) for p in phrases]


def aligned_slots(anchor: Column, own: Column) -> Column:
    """Array of (kind, slot, word): what a word list has at the words ("word") and boundaries ("insert") of an anchor; slots where it has nothing are left out."""
    kind = "array<struct<kind:string,slot:int,word:string>>"

    @F.pandas_udf(kind)
    def slots(anchors: pd.Series, owns: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(anchors, owns, strict=True):
            both = align_words(list(a), list(b))
            out.append([{"kind": k, "slot": i, "word": w} for k, ws in zip(("word", "insert"), both, strict=True) for i, w in enumerate(ws) if w])
        return pd.Series(out, dtype=object)

    return slots(anchor, own)


def collapsed_words(text: str | None, longest: int = 4) -> str:
    """``collapse_repeats`` of one text."""
    own = (text or "").split()
    changed = True
    while changed:
        changed = False
        for n in range(longest, 0, -1):
            out: list[str] = []
            for w in own:
                out.append(w)
                if len(out) >= 2 * n and out[-1 - n] == w and out[-n:] == out[-2 * n : -n]:
                    del out[-n:]
                    changed = True
            own = out
    return " ".join(own)


#: Texts of an Arrow batch that are Python strings at a time.
SOME_TEXTS = 100


def collapse_repeats(text: Column, longest: int = 4) -> Column:
    """Immediate repetitions of 1 to ``longest`` words reduced to one, again and again until none is left. Few texts of a batch are Python strings at a time, and go back at once."""
    @F.arrow_udf("string")
    def collapse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for at in range(0, len(texts), SOME_TEXTS):
                yield pa.array([collapsed_words(t, longest) for t in texts.slice(at, SOME_TEXTS).to_pylist()], pa.string())

    return collapse(text)


def valley_breaks(text: Column, block: int = 20, least: int = 30) -> Column:
    """Word positions where the cosine of the word counts on both sides is lowest around and below its mean by half a deviation, at least ``least`` apart; the deepest first, of equals to twelve digits the first."""
    @F.pandas_udf("array<int>")
    def breaks(texts: pd.Series) -> pd.Series:
        from collections import Counter

        import numpy as np

        def one(t: str | None) -> list[int]:
            own = (t or "").lower().split()
            at = list(range(block, len(own) - block + 1, block // 2))
            score = []
            for k in at:
                a, b = Counter(own[k - block : k]), Counter(own[k : k + block])
                norm = np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
                score.append(round(float(sum(n * b[w] for w, n in a.items()) / norm), 12) if norm else 0.0)
            if len(score) < 3:
                return []
            s = np.array(score)
            low = [i for i in range(1, len(s) - 1) if s[i] <= s[i - 1] and s[i] <= s[i + 1] and s[i] < s.mean() - s.std() / 2]
            kept: list[int] = []
            for i in sorted(low, key=lambda i: (s[i], i)):
                if all(abs(at[i] - k) >= least for k in kept):
                    kept.append(at[i])
            return sorted(kept)

        return texts.map(one)

    return breaks(text)


#: Fixed value: what ends a clause.
CLAUSE_END = r"[.!?…。！？,，、]+\s*|\n+"


def collapse_clauses(text: Column, longest: int = 8) -> Column:
    """array<struct<key, start, end>>: clauses left when immediate repetitions of 1 to ``longest`` clauses are reduced to one, the shortest first, again and again until none is left. Clauses compare by ``clause_key``; one without a key joins the next, or the last; offsets are code points of the text."""
    @F.pandas_udf("array<struct<key:string,start:int,end:int>>")
    def collapse(texts: pd.Series) -> pd.Series:
        import re
        import unicodedata

        ends = re.compile(CLAUSE_END)

        def key(t: str) -> str:
            return " ".join(re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", t).casefold()).split())

        def units(t: str) -> list[tuple[str, int, int]]:
            out, start, at = [], 0, 0
            for end, past in [*((m.start(), m.end()) for m in ends.finditer(t)), (len(t), len(t))]:
                if own := key(t[at:end]):
                    out.append((own, start, past))
                    start = past
                at = past
            if start < len(t):
                out = [*out[:-1], (out[-1][0], out[-1][1], len(t))] if out else [("", 0, len(t))]
            return out

        def one(t: str | None) -> list[dict]:
            own, before = units(t or ""), -1
            while len(own) != before:
                before, keys, kept, i = len(own), [u[0] for u in own], [], 0
                while i < len(own):
                    k = next((k for k in range(1, longest + 1) if i + 2 * k <= len(own) and keys[i : i + k] == keys[i + k : i + 2 * k]), 0)
                    kept += own[i : i + max(k, 1)]
                    j = i + max(k, 1)
                    while k and keys[j : j + k] == keys[i : i + k]:
                        j += k
                    i = j
                own = kept
            return [{"key": a, "start": b, "end": c} for a, b, c in own]

        return pd.Series([one(t) for t in texts], dtype=object)

    return collapse(text)


def parse_snippet(cell: Column) -> Column:
    """Struct (spans, problems) of a list literal of clock pairs: spans in whole seconds as written, and a reason for every item that gives none. An empty cell has neither; one that is no list is a problem as a whole."""
    own = F.trim(F.coalesce(cell, F.lit("")))
    inside = F.regexp_extract(own, r"(?s)^\[(.*)\]$", 1)
    # items are lists without lists inside, or what stands between commas outside of them
    items = F.filter(F.transform(F.regexp_extract_all(inside, F.lit(r"\[[^\[\]]*\]|[^,\[\]]+"), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")

    def judged(item: Column) -> Column:
        parts = F.transform(F.split(F.regexp_extract(item, r"(?s)^\[(.*)\]$", 1), ","), lambda p: F.regexp_replace(F.trim(p), r"^(['\"])(.*)\1$", "$2"))
        pair = item.startswith("[") & (F.size(parts) == 2)
        start, end = parse_clock(F.get(parts, 0)), parse_clock(F.get(parts, 1))
        reason = F.when(~pair, "malformed_pair").when(start.isNull() | end.isNull(), "unparseable_time").when(end <= start, "non_positive_duration")
        return F.struct(F.concat(reason, F.lit(":"), item).alias("problem"), start.cast("double").alias("start"), end.cast("double").alias("end"))

    all_ = F.transform(items, judged)
    whole = own.rlike(r"(?s)^\[.*\]$")
    spans = F.transform(F.filter(all_, lambda x: x["problem"].isNull()), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    problems = F.transform(F.filter(all_, lambda x: x["problem"].isNotNull()), lambda x: x["problem"])
    none = F.array().cast("array<struct<start:double,end:double>>")
    return F.when(own == "", F.struct(none.alias("spans"), F.array().cast("array<string>").alias("problems"))).when(~whole, F.struct(none.alias("spans"), F.array(F.lit("unparseable_cell")).alias("problems"))).otherwise(F.struct(spans.alias("spans"), problems.alias("problems")))

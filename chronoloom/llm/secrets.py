"""Secret scans with multipart credential linking, all in Spark expressions and joins.

Base spans are certain by themselves: assignments of a secret (``assign``), access
identifiers of a known form (``access``) and long runs of hexadecimal digits
(``hex``). Weak candidates say little alone: names of users and clients (``id``),
assignments to looser words and bearer values (``pass``), opaque tokens with upper
case, lower case and digits (``opaque``), and services that a credential would be
for (``endpoint``). Each part has a role: identifier (``access``, ``id``), secret
(``assign``, ``hex``, ``pass``, ``opaque``) or endpoint.

A weak candidate is reported if its complement co-occurs: for an identifier a
secret, for a secret an identifier, for an endpoint either a base secret or a weak
secret with an identifier. Two parts co-occur if both are in one scope and at most
``reach`` code points lie between them; parts that overlap don't. Scopes end at
blank lines and before a line that begins with a square bracket.

Parts and scopes are found within each row; rows that hold a weak candidate and a
possible complement send their parts to an interval join. A part is a point at its
start and one at its end, in a cell of ``reach`` code points; a candidate looks for
starts in the two cells after its end and for ends in the two cells before its
start. Row, scope, side and cell are the join's key. Parts of a kind don't overlap
and have at least four code points, so a cell holds a bounded number of them, and
the join's work grows with the parts however many a text or a group of copies has.

Null and empty texts have no spans. Equal texts get equal spans, repeated rows and
rows without a key too: rows are told apart by a number that the first table, once
written, holds for good. Of two parts at one place both stand. Very long texts are
read whole; offsets come from running sums over blocks of matches, so a text with
very many matches costs little more than its length. Only key and text are read,
whatever other columns are called. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.shared import let, stored

#: Kinds in the order in which spans at one place are listed; the first three are base spans.
KINDS = ("assign", "access", "hex", "id", "pass", "opaque", "endpoint")
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "pass": "secret", "opaque": "secret", "endpoint": "endpoint"}
REACH = 200

_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = r"[A-Za-z0-9+/_.=-]+"
_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)" + _GIVEN
#: Whole matches of a kind.
PATTERNS = {
    "assign": _ASSIGN + _VALUE,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "id": r"(?i:access_?key_?id|client_?id|account_?id|user_?name|user_?id|user|login)" + _GIVEN + r"[A-Za-z0-9@._+-]{3,}",
    "pass": r"(?i:pass_?phrase|pass_?code|pass|pwd|credentials?|private_?key|access_?key|auth)" + _GIVEN + r"[A-Za-z0-9+/_.=~!@#$%^&*-]{4,}|(?i:bearer)\x20+[A-Za-z0-9+/_.=~-]{8,}",
    "opaque": r"[A-Za-z0-9+/_-]{20,}={0,2}",
    "endpoint": r"""(?i:https?|ftps?|sftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqps?|s3)://[^\x00-\x20"'<>]+|(?i:host_?name|host|endpoint|server|base_?url)""" + _GIVEN + r"[A-Za-z0-9._:/-]{3,}",
}
#: What a match needs besides: the value's least length, or characters of each class.
LEAST_VALUE = 6
CLASSES = ("[A-Z]", "[a-z]", "[0-9]")
SCOPE_END = r"\n(?:[\x20\t\r]*\n)+|\n\["

BLOCK = 64
SPAN = "array<struct<start:int,kind:int,end:int>>"


def running(numbers: Column) -> Column:
    """Running sums of a list: inside blocks first, then over the blocks' totals, so that no step copies a long list."""

    def summed(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(xs, start, lambda a, x: let(a["last"] + x, lambda s: F.struct(s.alias("last"), F.concat(a["all"], F.array(s)).alias("all"))), lambda a: a["all"])

    def over(blocks: Column) -> Column:
        before = summed(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(before, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: x + F.when(i > 0, F.get(t, i - 1)).otherwise(0)))))

    n_blocks = F.floor((F.size(numbers) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks), lambda k: summed(F.slice(numbers, k * BLOCK + 1, F.lit(BLOCK))))
    return F.when(F.size(numbers) == 0, F.array().cast("array<int>")).otherwise(let(blocks, over))


def places(text: Column, pattern: str, good=None) -> Column:
    """Start and end of each match that is ``good``, leftmost first."""
    own = lambda: F.array().cast("array<struct<start:int,end:int>>")

    def of(found: Column) -> Column:
        between = F.split(text, pattern, -1)
        ends = let(between, lambda b: running(F.transform(found, lambda m, i: F.length(F.get(b, i)) + F.length(m))))
        spans = let(ends, lambda e: F.transform(found, lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"))))
        return spans if good is None else let(spans, lambda s: F.filter(s, lambda x, i: good(F.get(found, i))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, own()).otherwise(of(found)))


def _spans(text: Column, kind: str) -> Column:
    good = {
        "assign": lambda m: F.length(F.regexp_extract(m, f"^{_ASSIGN}({_VALUE})$", 1)) >= LEAST_VALUE,
        "opaque": lambda m: m.rlike(CLASSES[0]) & m.rlike(CLASSES[1]) & m.rlike(CLASSES[2]),
    }
    return F.transform(places(text, PATTERNS[kind], good.get(kind)), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Base spans (start, kind, end) by start, then kind."""
    return F.array_sort(F.concat(*[_spans(text, k) for k in KINDS[:3]]))


def weak_spans(text: Column) -> Column:
    """Weak candidates (start, kind, end) by start, then kind."""
    return F.array_sort(F.concat(*[_spans(text, k) for k in KINDS[3:]]))


def _has(spans: Column, *kinds: str) -> Column:
    return F.exists(spans, lambda s: s["kind"].isin([KINDS.index(k) for k in kinds]))


def _complete(base: Column, weak: Column) -> Column:
    """A weak candidate and a possible complement are in the row."""
    ids, secrets = (_has(base, "access") | _has(weak, "id")), (_has(base, "assign", "hex") | _has(weak, "pass", "opaque"))
    return (F.size(weak) > 0) & secrets & (ids | (_has(weak, "endpoint") & _has(base, "assign", "hex")))


def scoped(text: Column, spans: Column) -> Column:
    """Sorted spans with the number of scope ends before each."""
    ends = F.transform(places(text, SCOPE_END), lambda s: F.struct(s["start"].alias("start"), F.lit(-1).alias("kind"), s["end"].alias("end")))

    def numbered(all_: Column) -> Column:
        scope = running(F.transform(all_, lambda s: (s["kind"] < 0).cast("int")))
        return let(scope, lambda n: F.filter(F.transform(all_, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.get(n, i).alias("scope"))), lambda s: s["kind"] >= 0))

    return let(F.array_sort(F.concat(ends, spans)), numbered)


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text, written: row (a number of its own), key, base, parts (with scopes; null where nothing can be linked)."""
    own = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    both = F.struct(base_spans(F.col("t")).alias("base"), weak_spans(F.col("t")).alias("weak"))
    parts = lambda b: F.when(_complete(b["base"], b["weak"]), scoped(F.col("t"), F.concat(b["base"], b["weak"])))
    found = let(both, lambda b: F.struct(b["base"].alias("base"), parts(b).alias("parts")))
    return stored(own.select("row", "key", found.alias("f")).select("row", "key", "f.base", "f.parts"), "secret-parts")


def _of(kinds: list[str]) -> Column:
    return F.col("kind").isin([KINDS.index(k) for k in kinds])


def linked(table: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak candidates of a ``scanned`` table whose complement co-occurs: row, start, kind, end, with_id, with_secret."""
    parts = table.where("parts is not null").select("row", F.explode("parts").alias("p")).select("row", "p.*")
    cell = lambda at: F.floor(at / F.lit(reach))
    side = lambda after, at: F.struct(F.lit(after).alias("after"), at.alias("point"), cell(at).alias("cell"))
    points = parts.select("row", "scope", F.col("kind").alias("other"), F.explode(F.array(side(True, F.col("start")), side(False, F.col("end")))).alias("x")).select("row", "scope", "other", "x.*")
    ahead = F.array(*[F.struct(F.lit(True).alias("after"), (cell(F.col("end")) + k).alias("cell")) for k in (0, 1)], *[F.struct(F.lit(False).alias("after"), (cell(F.col("start")) - k).alias("cell")) for k in (0, 1)])
    seekers = parts.where(F.col("kind") >= 3).select("*", F.explode(ahead).alias("x")).select("row", "scope", "start", "kind", "end", "x.*")
    near = F.when(F.col("after"), F.col("point").between(F.col("end"), F.col("end") + reach)).otherwise(F.col("point").between(F.col("start") - reach, F.col("start")))
    met = seekers.join(points, ["row", "scope", "after", "cell"]).where(near)
    other = lambda kinds: F.col("other").isin([KINDS.index(k) for k in kinds])
    by_role = {r: [k for k in KINDS if ROLES[k] == r] for r in ("id", "secret")}
    found = met.groupBy("row", "start", "kind", "end").agg(F.bool_or(other(by_role["id"])).alias("with_id"), F.bool_or(other(by_role["secret"])).alias("with_secret"), F.bool_or(other(["assign", "hex"])).alias("with_base"))
    wanted = F.when(_of(["id"]), F.col("with_secret")).when(_of(["endpoint"]), F.col("with_base") | (F.col("with_secret") & F.col("with_id"))).otherwise(F.col("with_id"))
    return found.where(wanted).drop("with_base")


def found(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """One row per text: key, base (base spans), more (weak candidates with their complements), both by start, then kind."""
    table = scanned(docs, key, text)
    more = linked(table, reach).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("more"))
    return table.join(more, "row", "left").select("key", "base", F.coalesce("more", F.array().cast(SPAN)).alias("more"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: key, n_assign, n_access, n_hex, n_linked, base_sha256, spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found(docs, key, text).select(F.col("key").alias(key), *map(count, KINDS[:3]), F.size("more").cast("long").alias("n_linked"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "more"))).alias("spans"))

"""Quality rules: counts and a hashed n-gram log-likelihood ratio, all in Spark expressions.

Words' hashes and hashes of neighbouring words' hashes go into ``buckets``. Two smoothed
multinomials over the buckets are counted: one of a bounded sample of trusted
texts (quality 1 and not toxic), one of every text. The weight of a bucket is
the logarithm of their ratio in whole millionths, so that a text's sum is an
exact integer whatever the partitioning. A text is kept if it passes the base
rules and its mean weight per n-gram is at least ``least`` millionths.

The weights are ``buckets`` integers, a number that no input changes; they travel
as a literal inside the expression, so scoring neither joins nor shuffles.

Null and empty texts have no words, fail the base rules and have no ratio. Without any trusted
text the base rules alone decide and the ratio is null. Repeated rows count as
often as they occur. A text with just the least mean weight is kept. Very long
texts are read whole. Only the named columns are read; ``filtered`` carries the
others along whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.shared import let

BUCKETS = 10_000
#: Expected rows of the trusted sample; labels are drawn by a hash of their key.
TRUSTED_ROWS = 20_000
#: Least mean weight per n-gram, in millionths.
LEAST = -50_000
SMOOTHING = 1.0
WINDOW = 5


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _pair(h: Column, x: Column, i: Column) -> Column:
    """Hash of a word's hash and the next one's; null for the last word."""
    return F.when(i + 1 < F.size(h), F.xxhash64(x, F.get(h, i + 1)))


def _buckets(h: Column, buckets: int) -> Column:
    """Bucket of each word, then of each pair of neighbours, from the words' hashes."""
    pairs = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.pmod(_pair(h, x, i), F.lit(buckets)))
    return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(buckets))), pairs)


def _weight(h: Column, held: Column, buckets: int) -> Column:
    """Sum of the weights of all words and pairs."""
    own = lambda x: F.get(held, F.pmod(x, F.lit(buckets)).cast("int"))
    return F.aggregate(F.transform(h, lambda x, i: own(x) + F.coalesce(own(_pair(h, x, i)), F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)


def _repeated_words(w: Column, h: Column) -> Column:
    """Words inside 5-word windows that the text holds twice or more. Equal windows have equal hashes, so a text with as many hashes as windows has none; the others compare the words themselves."""
    n = F.size(w) - (WINDOW - 1)
    hashes = F.transform(F.slice(h, 1, F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
    starts = F.sequence(F.lit(0), n - 1)
    sorted_windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, WINDOW)).alias("t"), i.alias("i"))))
    repeated = lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: (x["t"] == F.get(s, k - 1)["t"]) | (x["t"] == F.get(s, k + 1)["t"])), lambda x: x["i"]))
    # a window adds the words that the one before it did not cover
    fold = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])
    counted = let(sorted_windows, lambda s: fold(repeated(s)))
    return F.when(n < 2, 0).otherwise(F.when(F.size(F.array_distinct(hashes)) == n, 0).otherwise(counted)).cast("long")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def weights(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> list[int] | None:
    """Weight of each bucket in millionths, or None without trusted texts. The counts are over all documents."""
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(key).alias("_trusted")).where("_trusted is not null").distinct()
    n = trusted.count()
    if n > trusted_rows:
        trusted = trusted.where(F.pmod(F.xxhash64(F.lit("trusted"), "_trusted"), F.lit(1_000_000)) < int(1_000_000 * trusted_rows / n))
    flagged = docs.select(key, text).join(F.broadcast(trusted), F.col(key) == F.col("_trusted"), "left")  # about trusted_rows ids
    grams = flagged.select(F.col("_trusted").isNotNull().alias("_t"), let(_hashes(words_of(F.col(text))), lambda h: _buckets(h, buckets)).alias("_g")).select("_t", F.explode("_g").alias("bucket"))
    rows = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("_t").alias("target")).collect()  # one row a bucket at most
    raw, target = [0] * buckets, [0] * buckets
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not sum(target):
        return None
    base = math.log(sum(raw) + SMOOTHING * buckets) - math.log(sum(target) + SMOOTHING * buckets)
    return [round(1e6 * (math.log(t + SMOOTHING) - math.log(r + SMOOTHING) + base)) for t, r in zip(target, raw, strict=True)]


def rules(text: Column, weight: list[int] | None, buckets: int = BUCKETS) -> Column:
    """Struct of the counts, the mean weight in millionths and the two verdicts."""
    held = None if weight is None else F.split(F.lit(" ".join(map(str, weight))), " ").cast("array<bigint>")

    def of(w: Column, h: Column) -> Column:
        n = F.size(w).cast("long")
        return F.struct(
            n.alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
            _dup_lines(text).alias("n_dup_lines"),
            _repeated_words(w, h).alias("n_repeat_words"),
            F.greatest(2 * n - 1, F.lit(0)).alias("n_grams"),
            (F.lit(None).cast("long") if held is None else _weight(h, held, buckets)).alias("weight"),
        )

    return let(
        let(words_of(text), lambda w: let(_hashes(w), lambda h: of(w, h))),
        lambda s: s.withField("base_failed", (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])),
    )


def kept(r: Column, least: int = LEAST) -> Column:
    """The verdict: base rules passed and total weight at least ``least`` for each n-gram."""
    return ~r["base_failed"] & (F.coalesce(r["weight"], least * r["n_grams"]) >= least * r["n_grams"])


def report(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: key, the counts, base_failed, ratio (mean weight per n-gram), kept."""
    weight = weights(docs, labels, key, text)
    judged = docs.select(key, rules(F.col(text), weight).alias("r"))
    fields = [F.col(f"r.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return judged.select(key, *fields, (F.try_divide("r.weight", "r.n_grams") / 1e6).alias("ratio"), kept(F.col("r")).alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that the rules reject."""
    judged = rules(F.col(text), weights(docs, labels, key, text))
    return docs.where(let(judged, lambda r: kept(r)))

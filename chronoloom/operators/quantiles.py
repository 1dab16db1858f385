"""Exact percentiles of large groups, without a task that holds or sorts a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.operators.ranks import splitters
from chronoloom.storage import stored


#: Distinct values of all groups together up to which a group's values are taken in one task.
TOGETHER = 2_000_000


def _same(left: list[str], right: list[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def percentiles(df: DataFrame, value: str, by: list[str], shares: Sequence[float], out: str = "q", parts: int = 64) -> DataFrame:
    """(by, out): the values at ``shares`` of a group's order, between two rows in proportion, as an array in the order of ``shares``.

    Nulls count as no row, NaN as the largest value; a group without values has no row, nor has an empty table. Values
    are counted before they are shuffled, so a value that most rows share is one row, and cut into ranges of (group,
    value). The counts of the ranges tell which of them hold the rows asked for; only these are ordered, each by itself,
    so the ranges of a group of most rows are tasks of their own. Up to TOGETHER distinct values a group's counts are taken
    in one task instead, with equal results.
    """
    counts = stored(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_s")).agg(F.count("*").alias("_n")), "percentile-counts")
    if counts.count() <= TOGETHER:
        return counts.groupBy(*by).agg(F.percentile("_s", list(shares), F.col("_n")).alias(out)).where(F.col(out).isNotNull())
    cuts = splitters(counts, [*by, "_s"], parts)
    parted = counts.withColumn("_part", F.size(F.filter(F.array(*cuts), lambda c: c <= F.struct(*by, "_s"))) if cuts else F.lit(0))
    whole = W.partitionBy(*by)
    through = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, 0))
    ranges = parted.groupBy(*by, "_part").agg(F.sum("_n").alias("_rows")).select("*", (through - F.col("_rows")).alias("_before"), F.sum("_rows").over(whole).alias("_total"))  # a row for each range and for each group
    places = [F.struct(F.lit(k).alias("k"), F.lit(float(s)).alias("share")) for k, s in enumerate(shares)]
    asked = ranges.select("*", F.explode(F.array(*places)).alias("_a")).withColumn("_at", F.col("_a.share") * (F.col("_total") - 1))
    ends = F.explode(F.array(*[F.struct(F.lit(e).alias("end"), f("_at").alias("rank")) for e, f in enumerate((F.floor, F.ceil))]))
    asked = asked.select(*by, "_part", "_before", F.col("_a.k").alias("_k"), "_at", ends.alias("_e")).where(F.col("_e.rank").between(F.col("_before"), F.col("_before") + F.col("_rows") - 1))
    asks = asked.groupBy(*by, "_part", "_before").agg(F.collect_list(F.struct("_k", F.col("_e.end").alias("end"), F.col("_e.rank").alias("rank"), "_at")).alias("_asks"))  # two a share at most
    named = [f"_by{k}" for k in range(len(by))]
    asks = asks.select(*[F.col(c).alias(n) for c, n in zip(by, named, strict=True)], F.col("_part").alias("_p"), "_before", "_asks")
    inside = parted.join(asks, _same([*by, "_part"], [*named, "_p"]))
    past = F.sum("_n").over(W.partitionBy(*by, "_part").orderBy("_s").rowsBetween(W.unboundedPreceding, 0)) + F.col("_before")
    placed = inside.withColumn("_past", past)
    hit = placed.select(*by, "_s", F.explode(F.filter("_asks", lambda a: (a["rank"] < F.col("_past")) & (a["rank"] >= F.col("_past") - F.col("_n")))).alias("_a"))
    pairs = hit.groupBy(*by, F.col("_a._k").alias("_k")).agg(F.max("_a._at").alias("_at"), *[F.max(F.when(F.col("_a.end") == e, F.col("_s"))).alias(n) for e, n in ((0, "_lo"), (1, "_hi"))])
    share = F.col("_at") - F.floor("_at")
    at = F.when(share == 0, F.col("_lo")).otherwise(F.col("_lo") + share * (F.col("_hi") - F.col("_lo")))
    return pairs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_k", at.alias("v")))).alias("_l")).select(*by, F.transform("_l", lambda x: x["v"]).alias(out))

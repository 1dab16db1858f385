"""Ranks, midranks and distribution functions; global ranks without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def splitters(df: DataFrame, order: list[str], parts: int, sampled: int = 4_000) -> list[Column]:
    """At most ``parts - 1`` quantiles of a sample of about ``sampled`` rows, drawn by hash, as struct literals in order."""
    n = df.count()
    own = df.select(*order)
    if n > sampled:
        own = own.where(F.pmod(F.xxhash64(*order), F.lit(1 << 30)) < int(sampled / n * (1 << 30)) + 1)
    rows = own.distinct().orderBy(*order).collect()
    chosen = [rows[k * len(rows) // parts] for k in range(1, parts)] if len(rows) >= parts else rows[1:]
    return [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(own.schema, r)]) for r in chosen]


def group_rank(df: DataFrame, by: list[str], order: list[str], out: str = "rank", size: str | None = None, parts: int = 64) -> DataFrame:
    """Rank from 0 in a group, and the group's rows in ``size``, without one task that sorts a group.

    Splitters of (group, order) cut all rows into parts of like size, so a group of most rows has most parts; a row's rank
    is its place in its part plus the group's rows in the parts before. The sample only sets the parts' sizes. Nulls come
    first and null keys are a group; rows alike in ``by`` and ``order`` share a part and get its places in any order.
    """
    cuts = splitters(df, [*by, *order], parts)
    part = F.size(F.filter(F.array(*cuts), lambda c: c <= F.struct(*by, *order))) if cuts else F.lit(0)
    parted = df.withColumn("_part", part)
    counts = parted.groupBy(*by, "_part").agg(F.count("*").alias("_rows"))  # a row for each part and for each group
    own = W.partitionBy(*by)
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_part").alias("_p"), before.alias("_before"), F.sum("_rows").over(own).alias("_size"))
    placed = parted.withColumn("_place", F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order)) - 1)
    same = F.col("_part").eqNullSafe(F.col("_p"))  # null-safe, as the optimizer would carry the part's expression over a plain equality
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    ranked = placed.join(counts if by else F.broadcast(counts), same).withColumn(out, F.col("_place") + F.col("_before"))
    return (ranked.withColumn(size, F.col("_size")) if size else ranked).drop("_part", "_p", "_place", "_before", "_size", *[f"_by{k}" for k in range(len(by))])


def global_rank(df: DataFrame, order: list[str], out: str = "rank", parts: int = 64) -> DataFrame:
    """Rank from 0 over all rows; see ``group_rank``. One row a part is broadcast."""
    return group_rank(df, [], order, out, parts=parts)


def midrank(value: Column | str, by: list[str]) -> Column:
    """Rank from 1 in a group; ties share the mean of their places."""
    ordered = W.partitionBy(*by).orderBy(value)
    peers = W.partitionBy(*by, value)
    return F.rank().over(ordered) + (F.count("*").over(peers) - 1) / 2


def centred_midrank(value: str, by: list[str]) -> Column:
    """(midrank - 1/2) / n - 1/2: 0 for a constant group."""
    return (midrank(value, by) - 0.5) / F.count("*").over(W.partitionBy(*by)) - 0.5


def tied_ecdf(value: str, by: list[str]) -> Column:
    """Midrank less 1 over n - 1; 1/2 for a constant or single value."""
    n = F.count("*").over(W.partitionBy(*by))
    least, most = F.min(value).over(W.partitionBy(*by)), F.max(value).over(W.partitionBy(*by))
    return F.when(least == most, 0.5).otherwise((midrank(value, by) - 1) / (n - 1))


def robust_unit(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """``df`` with the distance from the group's median in units of its MAD, or of its rms where that is zero; 0 for a constant group."""
    whole = W.partitionBy(*by)
    centred = df.withColumn("_c", F.col(value) - F.median(value).over(whole))
    scaled = centred.withColumns({"_mad": 1.4826 * F.median(F.abs("_c")).over(whole), "_rms": F.sqrt(F.avg(F.col("_c") * F.col("_c")).over(whole))})
    return scaled.withColumn(out, F.when(F.col("_mad") > 1e-12, F.col("_c") / F.col("_mad")).when(F.col("_rms") > 1e-12, F.col("_c") / F.col("_rms")).otherwise(0.0)).drop("_c", "_mad", "_rms")


def local_z(df: DataFrame, value: str, by: list[str], k: int) -> DataFrame:
    """``df`` with z: distance of the value from the mean of the k values around its place in its sorted group, in their deviations. Running sums at both ends of the window give the moments."""
    whole = W.partitionBy(*by)
    up = whole.orderBy(value)
    own = df.withColumns({"_x": F.col(value) - F.avg(value).over(whole), "_n": F.count("*").over(whole), "_below": F.rank().over(up) - 1})
    first = F.greatest(F.col("_below") - k // 2, F.lit(0))
    own = own.withColumn("_hi", F.least(F.col("_n"), first + k)).withColumn("_lo", F.greatest(F.col("_hi") - k, F.lit(0)))
    through = up.rowsBetween(W.unboundedPreceding, 0)
    sums = own.select(*by, F.row_number().over(up).alias("_at"), F.sum("_x").over(through).alias("_s1"), F.sum(F.col("_x") * F.col("_x")).over(through).alias("_s2"))
    for end in ("_hi", "_lo"):
        there = sums.select(*by, F.col("_at").alias(end), F.col("_s1").alias(f"{end}1"), F.col("_s2").alias(f"{end}2"))
        own = own.join(there, [*by, end], "left")
    moment = lambda p: (F.col(f"_hi{p}") - F.coalesce(f"_lo{p}", F.lit(0.0))) / (F.col("_hi") - F.col("_lo"))
    sd = F.sqrt(F.greatest(moment(2) - moment(1) ** 2, F.lit(0.0))) + 1e-12
    return own.select(*df.columns, ((F.col("_x") - moment(1)) / sd).alias("z"))


def value_counts(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Positives and negatives of each distinct score: what rank metrics need, aggregated before it is shuffled."""
    return df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.col(label).cast("long")).alias("_pos"), F.sum(1 - F.col(label).cast("long")).alias("_neg"))

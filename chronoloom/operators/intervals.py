"""Interval tables: range joins, rasters, merging, runs, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cells(start: Column, end: Column, width: float) -> Column:
    """Numbers of the cells of ``width`` that [start, end) touches; none if it is empty."""
    last = F.ceil(end / width).cast("long") - 1
    return F.when(end > start, F.sequence(F.floor(start / width).cast("long"), F.greatest(last, F.floor(start / width).cast("long")))).otherwise(F.array().cast("array<bigint>"))


def points_in_spans(points: DataFrame, spans: DataFrame, width: float, by: str = "gid", t: str = "t", how: str = "inner") -> DataFrame:
    """Join points to the half-open spans that hold them.

    Spans are dealt to time cells of ``width``, so that the join has an equality on
    (group, cell): it shuffles on many keys even if one group has most rows. A span
    of length L is copied about L / width + 1 times.
    """
    dealt = spans.select("*", F.explode(cells(F.col("start"), F.col("end"), width)).alias("_cell")).withColumnRenamed(by, "_by")
    held = points.withColumn("_at", F.floor(F.col(t) / width).cast("long"))
    on = (held[by] == dealt["_by"]) & (F.col("_at") == F.col("_cell")) & (held[t] >= dealt["start"]) & (held[t] < dealt["end"])
    joined = held.join(dealt, on, how)
    return joined.drop("_at") if how in ("left_semi", "left_anti") else joined.drop("_at", "_cell", "_by")


def overlaps(left: DataFrame, right: DataFrame, width: float, by: str = "gid") -> DataFrame:
    """Pairs of left [a, b) and right [start, end) of a group that overlap, with the length ``overlap``. A pair that shares several cells comes once, from the cell where its overlap begins."""
    l = left.select("*", F.explode(cells(F.col("a"), F.col("b"), width)).alias("_cell"))
    r = right.select("*", F.explode(cells(F.col("start"), F.col("end"), width)).alias("_rcell")).withColumnRenamed(by, "_by")
    begin, end = F.greatest("a", "start"), F.least("b", "end")
    joined = l.join(r, (l[by] == r["_by"]) & (F.col("_cell") == F.col("_rcell")) & (begin < end))
    return joined.where(F.floor(begin / width).cast("long") == F.col("_cell")).withColumn("overlap", end - begin).drop("_cell", "_rcell", "_by")


def merged(spans: DataFrame, gap: float = 0.0, by: str = "gid", strict: bool = False) -> DataFrame:
    """Unions of spans that overlap, touch, or (``gap``) nearly do: gid, start, end, n, v (largest). ``strict`` leaves touching ones apart."""
    order = W.partitionBy(by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)) + gap
    new = F.col("start") >= reach if strict else F.col("start") > reach
    islands = spans.where(F.col("end") > F.col("start")).withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    islands = islands.withColumn("_island", F.sum("_new").over(order))
    return islands.groupBy(by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.max("v").alias("v")).drop("_island")


def runs(series: DataFrame, on: Column, by: str = "gid", idx: str = "idx") -> DataFrame:
    """Maximal runs of consecutive positions where ``on`` holds: gid, first, last, n, peak (largest s)."""
    hit = series.where(on).withColumn("_island", F.col(idx) - F.row_number().over(W.partitionBy(by).orderBy(idx)))
    return hit.groupBy(by, "_island").agg(F.min(idx).alias("first"), F.max(idx).alias("last"), F.count("*").alias("n"), F.max("s").alias("peak")).drop("_island")


def hysteresis(series: DataFrame, high: Column, low: Column, by: str = "gid", idx: str = "idx") -> DataFrame:
    """Runs at or above ``low`` that reach ``high`` somewhere."""
    hit = series.where(F.col("s") >= low).withColumn("_seed", (F.col("s") >= high)).withColumn("_island", F.col(idx) - F.row_number().over(W.partitionBy(by).orderBy(idx)))
    out = hit.groupBy(by, "_island").agg(F.min(idx).alias("first"), F.max(idx).alias("last"), F.count("*").alias("n"), F.max("s").alias("peak"), F.max("_seed").alias("_ok"))
    return out.where("_ok").drop("_island", "_ok")


def close_gaps(run: DataFrame, most: int, by: str = "gid") -> DataFrame:
    """Runs united across gaps of at most ``most`` positions: gid, first, last, peak."""
    order = W.partitionBy(by).orderBy("first")
    new = F.col("first") - F.lag("last").over(order) - 1 > most
    islands = run.withColumn("_island", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order))
    return islands.groupBy(by, "_island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("peak").alias("peak")).drop("_island")


def tiling(spans: DataFrame, by: str = "gid") -> DataFrame:
    """How spans tile the time: gaps, overlaps, degenerate ones and their lengths."""
    step = F.lead("start").over(W.partitionBy(by).orderBy("start", "end")) - F.col("end")
    return spans.withColumn("_step", step).groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_step") > 0).alias("n_gaps"),
        F.count_if(F.col("_step") < 0).alias("n_overlaps"),
        F.count_if(F.col("end") <= F.col("start")).alias("n_degenerate"),
        F.coalesce(F.sum(F.greatest("_step", F.lit(0.0))), F.lit(0.0)).alias("gap_time"),
    )


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over the hull of two intervals; 0 if the hull is empty."""
    inter = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, inter / hull).otherwise(0.0)

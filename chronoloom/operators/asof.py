"""As-of joins without cross joins.

Both sides go into one stream of a group, ordered by time, and the last or next
sample's value is carried along. The stream is cut into time cells: inside a cell
a window carries values, and what a cell takes over from earlier cells comes from
one row per cell. So a group with most of all rows is spread over its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _carried(both: DataFrame, value: Column, width: float, by: str, t: str, order: list, ahead: bool) -> Column | DataFrame:
    cell = F.floor(F.col(t) / width).cast("long")
    marked = both.withColumn("_cell", cell).withColumn("_v", value)
    inside = W.partitionBy(by, "_cell").orderBy(*order)
    frame = inside.rowsBetween(0, W.unboundedFollowing) if ahead else inside.rowsBetween(W.unboundedPreceding, 0)
    own = F.first("_v", ignorenulls=True).over(frame) if ahead else F.last("_v", ignorenulls=True).over(frame)
    pick = F.min_by if ahead else F.max_by
    per_cell = marked.where("_v is not null").groupBy(by, "_cell").agg(pick("_v", F.struct(*[F.col(c) if isinstance(c, str) else c for c in (t, "_k")])).alias("_held"))
    cells = marked.select(by, "_cell").distinct().join(per_cell, [by, "_cell"], "left")
    over = W.partitionBy(by).orderBy("_cell")
    outer = over.rowsBetween(1, W.unboundedFollowing) if ahead else over.rowsBetween(W.unboundedPreceding, -1)
    brought = F.first("_held", ignorenulls=True).over(outer) if ahead else F.last("_held", ignorenulls=True).over(outer)
    return marked.withColumn("_own", own).join(cells.select(by, "_cell", brought.alias("_brought")), [by, "_cell"]).withColumn("_found", F.coalesce("_own", "_brought"))


def asof(points: DataFrame, samples: DataFrame, width: float, ahead: bool = False, by: str = "gid", t: str = "t") -> DataFrame:
    """``points`` with ``found``: the struct (t, v) of the last sample at or before each point, or with ``ahead`` the next at or after it; null if there is none. Of samples at one time, the last by value is found backwards, the first forwards."""
    columns = points.columns
    p = points.select(F.struct(*columns).alias("_row"), F.col(by), F.col(t), F.lit(None).cast("struct<t:double,v:double>").alias("_sample"), F.lit(1 if not ahead else -1).alias("_side"), F.lit(None).cast("double").alias("_k"))
    s = samples.select(F.lit(None).cast(p.schema["_row"].dataType).alias("_row"), F.col(by), F.col(t), F.struct(F.col(t).cast("double").alias("t"), F.col("v").cast("double").alias("v")).alias("_sample"), F.lit(0).alias("_side"), F.col("v").cast("double").alias("_k"))
    # forwards, a point stands before the samples of its time; backwards, behind them
    joined = _carried(p.unionByName(s), F.col("_sample"), width, by, t, [t, "_side", "_k"], ahead)
    return joined.where("_row is not null").select("_row.*", F.col("_found").alias("found"))


def nearest(points: DataFrame, samples: DataFrame, width: float, by: str = "gid", t: str = "t") -> DataFrame:
    """``points`` with ``found``: the nearest sample, the earlier of two equally near."""
    back = asof(points, samples, width, False, by, t).withColumnRenamed("found", "_back")
    both = asof(back, samples, width, True, by, t).withColumnRenamed("found", "_next")
    nearer = F.col("_back").isNull() | (F.col("_next.t") - F.col(t) < F.col(t) - F.col("_back.t"))
    return both.withColumn("found", F.when(nearer & F.col("_next").isNotNull(), F.col("_next")).otherwise(F.col("_back"))).drop("_back", "_next")

"""The library's record shapes read from the driver's tables.

curve: one score series per user, in hours since the first day. spans: an
interval for each purchase. grid: a frame every four hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.operators.ranks import group_rank

FRAME_HOURS = 4.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of the table up to which a series is numbered in one task.
TOGETHER = 5_000_000
_sizes: dict[tuple[str, str], int] = {}


def _many(spark: SparkSession, sf_dir: str) -> bool:
    """Whether the table is so long that a series may be too long for a task. Its size only chooses the plan, so one look a session will do."""
    at = spark.sparkContext.applicationId, sf_dir
    if at not in _sizes:
        _sizes[at] = read(spark, sf_dir, "events").count()
    return _sizes[at] > TOGETHER


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gid, idx, t, s, y: positions from 0 in time order, score, positive if an error. A query that doesn't read idx doesn't sort, as the optimizer drops the window; in long tables positions are taken in ranges."""
    columns = ["gid", "idx", "t", "s", "y", "event_type", "event_id"]
    if _many(spark, sf_dir):
        return ranked_curve(spark, sf_dir).select(*columns)
    e = read(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("gid"), (F.row_number().over(order) - 1).alias("idx"), hours().alias("t"), F.col("value").alias("s"), (F.col("event_type") == "error").cast("int").alias("y"), "event_type", "event_id")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``curve`` without idx. In long tables the ranges are no window that the optimizer could drop, so queries that need no positions read this."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("gid"), hours().alias("t"), F.col("value").alias("s"), (F.col("event_type") == "error").cast("int").alias("y"), "event_type", "event_id")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gid, ord, start, end, v: from each purchase, longer with its value."""
    c = points(spark, sf_dir).where("event_type = 'purchase'")
    return c.select("gid", (F.row_number().over(W.partitionBy("gid").orderBy("t", "event_id")) - 1).alias("ord"), F.col("t").alias("start"), (F.col("t") + 1 + F.col("s") / 4).alias("end"), F.col("s").alias("v"))


def hours() -> Column:
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', cast(ts as timestamp_ntz))") / F.lit(3.6e9)


def duration(spark: SparkSession, sf_dir: str) -> float:
    """Hours to the last event; 0 without events."""
    return read(spark, sf_dir, "events").agg(F.coalesce(F.max(hours()), F.lit(0.0)).alias("t")).first()["t"]


def n_cells(spark: SparkSession, sf_dir: str, width: float) -> int:
    """Cells of a width from 0 up to the one that holds the last event."""
    return int(duration(spark, sf_dir) // width) + 1


def ranked_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``curve``, with n, the rows of a series; in long tables positions are taken in ranges, so that a series of most rows is no single task."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("gid"), "ts", hours().alias("t"), F.col("value").alias("s"), (F.col("event_type") == "error").cast("int").alias("y"), "event_type", "event_id")
    if _many(spark, sf_dir):
        return group_rank(e, ["gid"], ["ts", "event_id"], "idx", size="n").drop("ts")
    own = W.partitionBy("gid")
    return e.withColumns({"idx": F.row_number().over(own.orderBy("ts", "event_id")) - 1, "n": F.count("*").over(own)}).drop("ts")


def shares(df: DataFrame, value: str = "s", out: str = "p") -> DataFrame:
    """``df`` with each value's place in the range of all values, 0 to 1."""
    r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    low, width = (0.0, 1.0) if r["lo"] is None else (r["lo"], (r["hi"] - r["lo"]) or 1.0)
    return df.withColumn(out, (F.col(value) - low) / width)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gid, frame, t: left edges of the frames of every user, up to the table's last event."""
    users = read(spark, sf_dir, "events").select(F.col("user_id").alias("gid")).distinct()
    frames = F.explode(F.sequence(F.lit(0), F.lit(n_cells(spark, sf_dir, FRAME_HOURS) - 1)))
    return users.select("gid", frames.alias("frame")).withColumn("t", F.col("frame") * FRAME_HOURS)


#: The same shapes for DuckDB, to begin a WITH list.
CURVE_SQL = """curve AS (SELECT user_id AS gid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  (epoch_us(ts) - 1704067200000000) / 3.6e9 AS t, value AS s, (event_type = 'error')::INT AS y, event_type, event_id FROM events)"""
SPANS_SQL = CURVE_SQL + """, spans AS (SELECT gid, row_number() OVER (PARTITION BY gid ORDER BY t, event_id) - 1 AS ord,
  t AS start, t + 1 + s / 4 AS "end", s AS v FROM curve WHERE event_type = 'purchase')"""
SHARE_SQL = "((s - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events))"
DURATION_SQL = "(SELECT max((epoch_us(ts) - 1704067200000000) / 3.6e9) FROM events)"


def cells_sql(width: float) -> str:
    """A list of the numbers of the cells of a width."""
    return f"range(floor({DURATION_SQL} / {width})::BIGINT + 1)"


GRID_SQL = f"""grid AS (SELECT gid, f AS frame, (f * {FRAME_HOURS})::DOUBLE AS t FROM (SELECT DISTINCT user_id AS gid FROM events), (SELECT unnest({cells_sql(FRAME_HOURS)}) AS f))"""

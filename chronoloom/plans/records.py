"""Queries on record shapes: canonical predictions, fills, resumable keys."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.plans.catalog import query
from chronoloom.plans.frames import CURVE_SQL, curve, read


@query("q_prediction_records", f"WITH {CURVE_SQL} SELECT gid, count(*) AS n, round(max(t), 6) AS duration, round(count(*) / max(t), 6) AS native_rate, round(list_sum(list(s ORDER BY idx)[1:5]), 6) AS head FROM curve GROUP BY gid")
def prediction_records(spark, sf):
    """A record per series with its score curve as an array in time order."""
    r = curve(spark, sf).groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("idx", "s"))).alias("c"), F.max("t").alias("duration"))
    score = F.transform("c", lambda x: x["s"])
    r = r.select("gid", score.alias("score_curve"), "duration")
    return r.select("gid", F.size("score_curve").cast("long").alias("n"), F.round("duration", 6).alias("duration"), F.round(F.size("score_curve") / F.col("duration"), 6).alias("native_rate"), F.round(F.aggregate(F.slice("score_curve", 1, 5), F.lit(0.0), lambda a, x: a + x), 6).alias("head"))


@query("q_first_observed_wins", f"WITH {CURVE_SQL} SELECT gid, floor(t / 6)::BIGINT AS position, arg_min(s, event_id) AS s, count(*) AS n FROM curve GROUP BY ALL")
def first_observed_wins(spark, sf):
    """Of blocks that overlap, the one that arrived first."""
    return curve(spark, sf).groupBy("gid", F.floor(F.col("t") / 6).alias("position")).agg(F.min_by("s", "event_id").alias("s"), F.count("*").alias("n"))


@query("q_done_ids", f"WITH {CURVE_SQL}, l AS (SELECT gid, arg_max(event_type, event_id) AS last FROM curve GROUP BY gid) SELECT gid FROM l WHERE last <> 'error'")
def done_ids(spark, sf):
    """Keys whose last record didn't fail."""
    return curve(spark, sf).groupBy("gid").agg(F.max_by("event_type", "event_id").alias("last")).where("last <> 'error'").select("gid")


@query("q_gap_crop", f"WITH {CURVE_SQL}, p AS (SELECT gid, floor(t / 6)::BIGINT AS position, avg(s) AS s FROM curve GROUP BY ALL) SELECT g.gid, i AS position, round(s, 6) AS s, (s IS NOT NULL) AS observed FROM (SELECT DISTINCT gid FROM curve) g, range(20, 40) r(i) LEFT JOIN p ON p.gid = g.gid AND p.position = i")
def gap_crop(spark, sf):
    """Positions 20 to 39 of a sampled series, the crop asked for, with its gaps."""
    c = curve(spark, sf)
    p = c.groupBy("gid", F.floor(F.col("t") / 6).alias("position")).agg(F.avg("s").alias("s"))
    g = c.select("gid").distinct().select("gid", F.explode(F.sequence(F.lit(20), F.lit(39)).cast("array<bigint>")).alias("position"))
    return g.join(p, ["gid", "position"], "left").select("gid", "position", F.round("s", 6).alias("s"), F.col("s").isNotNull().alias("observed"))


@query("q_full_batches", f"WITH {CURVE_SQL} SELECT gid, idx // 16 AS batch, round(avg(s), 6) AS mean FROM curve GROUP BY ALL HAVING count(*) = 16")
def full_batches(spark, sf):
    """Tumbling batches of sixteen, the incomplete last one dropped."""
    b = curve(spark, sf).groupBy("gid", F.floor(F.col("idx") / 16).alias("batch")).agg(F.avg("s").alias("mean"), F.count("*").alias("n"))
    return b.where("n = 16").select("gid", "batch", F.round("mean", 6).alias("mean"))


@query("q_gap_tracks", f"WITH {CURVE_SQL}, g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY gid, event_type ORDER BY t, event_id) > 48, true)::INT AS new FROM curve), k AS (SELECT *, sum(new) OVER (PARTITION BY gid, event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT gid, event_type, k::BIGINT AS track, count(*) AS n, round(min(t), 6) AS start, round(max(t), 6) AS \"end\" FROM k GROUP BY ALL")
def gap_tracks(spark, sf):
    """Tracks that end after 48 hours without an observation."""
    o = W.partitionBy("gid", "event_type").orderBy("t", "event_id")
    new = F.coalesce(F.col("t") - F.lag("t").over(o) > 48, F.lit(True)).cast("int")
    k = curve(spark, sf).withColumn("new", new).withColumn("track", F.sum("new").over(o))
    return k.groupBy("gid", "event_type", "track").agg(F.count("*").alias("n"), F.round(F.min("t"), 6).alias("start"), F.round(F.max("t"), 6).alias("end"))


@query("q_static_dynamic_groups", f"WITH {CURVE_SQL}, d AS (SELECT *, abs(s - lag(s) OVER (PARTITION BY gid ORDER BY idx)) < 10 AS still FROM curve) SELECT gid, count(*) FILTER (still) AS n_static, count(*) FILTER (still IS NOT TRUE) AS n_dynamic, round(avg(s) FILTER (still IS NOT TRUE), 6) AS mean FROM d GROUP BY gid")
def static_dynamic_groups(spark, sf):
    """Positions grouped by whether they moved since the one before."""
    still = F.coalesce(F.abs(F.col("s") - F.lag("s").over(W.partitionBy("gid").orderBy("idx"))) < 10, F.lit(False))
    d = curve(spark, sf).select("gid", "s", still.alias("still"))
    return d.groupBy("gid").agg(F.count_if("still").alias("n_static"), F.count_if(~F.col("still")).alias("n_dynamic"), F.round(F.avg(F.when(~F.col("still"), F.col("s"))), 6).alias("mean"))


@query("q_lineitem_spans", "SELECT o_custkey, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def lineitem_spans(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.round(F.sum("o_totalprice"), 2).alias("total"))

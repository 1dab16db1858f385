"""Queries on intervals: merging, runs, hysteresis, tiling, rasters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.operators import intervals as I
from chronoloom.plans.catalog import query
from chronoloom.plans.frames import CURVE_SQL, DURATION_SQL, FRAME_HOURS, GRID_SQL, SPANS_SQL, cells_sql, curve, duration, grid, n_cells, spans

#: Width of the time cells of range joins, in hours.
CELL = 24.0


def _r(*names, n=6):
    return [F.round(x, n).alias(x) for x in names]


def _merge_sql(gap: float) -> str:
    return f"""m0 AS (SELECT *, max("end") OVER (PARTITION BY gid ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans WHERE "end" > start),
    m1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY gid ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m0),
    merged AS (SELECT gid, min(start) AS start, max("end") AS "end", count(*) AS n, max(v) AS v FROM m1 GROUP BY gid, island)"""


for _gap, _name in ((0.0, "q_merge_spans"), (6.0, "q_merge_spans_gap")):

    def _merge(spark, sf, gap=_gap):
        return I.merged(spans(spark, sf), gap).select("gid", *_r("start", "end"), "n", "v")

    query(_name, f'WITH {SPANS_SQL}, {_merge_sql(_gap)} SELECT gid, round(start, 6) AS start, round("end", 6) AS "end", n, v FROM merged')(_merge)

_RUNS = "r0 AS (SELECT *, idx - row_number() OVER (PARTITION BY gid ORDER BY idx) AS island FROM curve WHERE {on}), runs AS (SELECT gid, min(idx) AS first, max(idx) AS last, count(*) AS n, max(s) AS peak FROM r0 GROUP BY gid, island)"


@query("q_runs_to_intervals", f"WITH {CURVE_SQL}, {_RUNS.format(on='s >= 60')} SELECT * FROM runs")
def runs_to_intervals(spark, sf):
    return I.runs(curve(spark, sf), F.col("s") >= 60)


@query("q_binary_intervals", f"WITH {CURVE_SQL}, {_RUNS.format(on='y = 1')} SELECT gid, first / 4.0 AS start, (last + 1) / 4.0 AS \"end\" FROM runs")
def binary_intervals(spark, sf):
    r = I.runs(curve(spark, sf), F.col("y") == 1)
    return r.select("gid", (F.col("first") / 4).alias("start"), ((F.col("last") + 1) / 4).alias("end"))


@query(
    "q_hysteresis_spans",
    f"""WITH {CURVE_SQL}, q AS (SELECT gid, quantile_cont(s, 0.8) AS high, quantile_cont(s, 0.4) AS low FROM curve GROUP BY gid),
    h0 AS (SELECT gid, idx, s, high, idx - row_number() OVER (PARTITION BY gid ORDER BY idx) AS island FROM curve JOIN q USING (gid) WHERE s >= low)
    SELECT gid, min(idx) AS first, max(idx) AS last, count(*) AS n, max(s) AS peak FROM h0 GROUP BY gid, island HAVING bool_or(s >= high)""",
)
def hysteresis_spans(spark, sf):
    c = curve(spark, sf)
    q = c.groupBy("gid").agg(F.percentile("s", 0.8).alias("high"), F.percentile("s", 0.4).alias("low"))
    return I.hysteresis(c.join(q, "gid"), F.col("high"), F.col("low"))


_HYST = f"""{CURVE_SQL}, q AS (SELECT gid, quantile_cont(s, 0.8) AS high, quantile_cont(s, 0.4) AS low FROM curve GROUP BY gid),
    h0 AS (SELECT gid, idx, s, high, idx - row_number() OVER (PARTITION BY gid ORDER BY idx) AS island FROM curve JOIN q USING (gid) WHERE s >= low),
    hyst AS (SELECT gid, min(idx) AS first, max(idx) AS last, count(*) AS n, max(s) AS peak FROM h0 GROUP BY gid, island HAVING bool_or(s >= high))"""


@query("q_top_hysteresis", f"WITH {_HYST}, k AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY peak DESC, first) AS r FROM hyst) SELECT gid, first, last, n, peak FROM k WHERE r <= 4")
def top_hysteresis(spark, sf):
    """The four spans of each series with the highest peaks."""
    r = F.row_number().over(W.partitionBy("gid").orderBy(F.desc("peak"), "first"))
    return hysteresis_spans(spark, sf).withColumn("r", r).where("r <= 4").drop("r")


@query(
    "q_close_and_filter",
    f"""WITH {CURVE_SQL}, {_RUNS.format(on='s >= 55')}, c0 AS (SELECT *, coalesce(first - lag(last) OVER (PARTITION BY gid ORDER BY first) - 1 > 2, true)::INT AS new FROM runs),
    c1 AS (SELECT *, sum(new) OVER (PARTITION BY gid ORDER BY first ROWS UNBOUNDED PRECEDING) AS island FROM c0)
    SELECT gid, min(first) AS first, max(last) AS last, max(peak) AS peak FROM c1 GROUP BY gid, island HAVING max(last) - min(first) + 1 >= 4""",
)
def close_and_filter(spark, sf):
    """Gaps of up to two positions closed, then runs of four positions or more."""
    return I.close_gaps(I.runs(curve(spark, sf), F.col("s") >= 55), 2).where("last - first + 1 >= 4")


@query(
    "q_persistent_mask",
    f"WITH {CURVE_SQL}, q AS (SELECT gid, quantile_cont(s, [0.6, 0.7, 0.8, 0.9]) AS q FROM curve GROUP BY gid), m AS (SELECT gid, idx, s, len(list_filter(q, lambda x: s >= x)) AS level FROM curve JOIN q USING (gid)), {_RUNS.format(on='level >= 2').replace('FROM curve', 'FROM m')} SELECT * FROM runs",
)
def persistent_mask(spark, sf):
    """Runs that stand above at least two of four quantile levels."""
    c = curve(spark, sf)
    q = c.groupBy("gid").agg(F.percentile("s", [0.6, 0.7, 0.8, 0.9]).alias("q"))
    level = F.size(F.filter("q", lambda x: F.col("s") >= x))
    return I.runs(c.join(q, "gid"), level >= 2)


@query("q_excursion_hull", f"WITH {CURVE_SQL}, a AS (SELECT *, avg(s) OVER (PARTITION BY gid) AS m FROM curve), h AS (SELECT gid, any_value(m) AS m, min(idx) FILTER (s > m + 1e-9) AS first, max(idx) FILTER (s > m + 1e-9) AS last FROM a GROUP BY gid HAVING count(*) FILTER (s > m + 1e-9) > 0) SELECT h.gid, first, last, round(avg(s) - any_value(m), 6) AS confidence FROM h JOIN curve c ON c.gid = h.gid AND c.idx BETWEEN first AND last GROUP BY ALL")
def excursion_hull(spark, sf):
    """First and last position above the mean, and by how much the mean between them is above it; no row without any."""
    c = curve(spark, sf)
    above = c.join(c.groupBy("gid").agg(F.avg("s").alias("m")), "gid")
    hit = F.when(F.col("s") > F.col("m") + 1e-9, F.col("idx"))
    hull = above.groupBy("gid").agg(F.min(hit).alias("first"), F.max(hit).alias("last"), F.first("m").alias("m")).where("first is not null")
    inside = c.join(hull, "gid").where("idx between first and last")
    return inside.groupBy("gid", "first", "last").agg(F.round(F.avg("s") - F.first("m"), 6).alias("confidence"))


@query(
    "q_component_around_max",
    f"WITH {CURVE_SQL}, {_RUNS.format(on='s > 40')}, m AS (SELECT gid, arg_max(idx, (s, -idx)) AS top FROM curve GROUP BY gid) SELECT gid, first, last, n, peak FROM runs JOIN m USING (gid) WHERE top BETWEEN first AND last",
)
def component_around_max(spark, sf):
    c = curve(spark, sf)
    top = c.groupBy("gid").agg(F.max_by("idx", F.struct("s", -F.col("idx"))).alias("at"))
    return I.runs(c, F.col("s") > 40).join(top, "gid").where("at between first and last").drop("at")


@query(
    "q_max_sum_interval",
    f"""WITH {CURVE_SQL}, p AS (SELECT gid, idx, sum(s - 50) OVER (PARTITION BY gid ORDER BY idx ROWS UNBOUNDED PRECEDING) AS p FROM curve),
    b AS (SELECT gid, idx, p, least(0, coalesce(min(p) OVER (PARTITION BY gid ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM p) SELECT gid, round(max(p - low), 6) AS best FROM b GROUP BY gid""",
)
def max_sum_interval(spark, sf):
    """Largest sum of a stretch: a prefix sum less the least one before it."""
    o = W.partitionBy("gid").orderBy("idx")
    p = curve(spark, sf).withColumn("p", F.sum(F.col("s") - 50).over(o.rowsBetween(W.unboundedPreceding, 0)))
    low = F.least(F.lit(0.0), F.coalesce(F.min("p").over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    return p.withColumn("low", low).groupBy("gid").agg(F.round(F.max(F.col("p") - F.col("low")), 6).alias("best"))


@query(
    "q_tiling_report",
    f"""WITH {SPANS_SQL}, s AS (SELECT *, lead(start) OVER (PARTITION BY gid ORDER BY start, "end") - "end" AS step FROM spans)
    SELECT gid, count(*) AS n, count(*) FILTER (step > 0) AS n_gaps, count(*) FILTER (step < 0) AS n_overlaps, count(*) FILTER ("end" <= start) AS n_degenerate, round(coalesce(sum(greatest(step, 0)), 0), 6) AS gap_time FROM s GROUP BY gid""",
)
def tiling_report(spark, sf):
    return I.tiling(spans(spark, sf)).withColumn("gap_time", F.round("gap_time", 6))


@query("q_clock_overshoot", f"WITH {SPANS_SQL}, c AS (SELECT gid, max(t) AS d FROM curve GROUP BY gid) SELECT gid, round(max(\"end\") - any_value(d), 6) AS overshoot FROM spans JOIN c USING (gid) GROUP BY gid HAVING max(\"end\") > any_value(d)")
def clock_overshoot(spark, sf):
    last = curve(spark, sf).groupBy("gid").agg(F.max("t").alias("d"))
    return spans(spark, sf).groupBy("gid").agg(F.max("end").alias("e")).join(last, "gid").where("e > d").select("gid", F.round(F.col("e") - F.col("d"), 6).alias("overshoot"))


@query("q_span_raster", f"WITH {SPANS_SQL}, {GRID_SQL} SELECT gid, frame, EXISTS (SELECT 1 FROM spans s WHERE s.gid = grid.gid AND t >= s.start AND t < s.\"end\")::INT AS y FROM grid")
def span_raster(spark, sf):
    """Frames inside any span."""
    g = grid(spark, sf)
    hit = I.points_in_spans(g, spans(spark, sf), CELL, how="left_semi").select("gid", "frame", F.lit(1).alias("hit"))
    return g.join(hit, ["gid", "frame"], "left").select("gid", "frame", F.coalesce("hit", F.lit(0)).alias("y"))


@query("q_first_span_wins", f"WITH {SPANS_SQL}, {GRID_SQL} SELECT grid.gid, frame, coalesce(arg_min(v, ord), -1.0) AS v FROM grid LEFT JOIN spans s ON s.gid = grid.gid AND t >= s.start AND t < s.\"end\" GROUP BY grid.gid, frame")
def first_span_wins(spark, sf):
    joined = I.points_in_spans(grid(spark, sf), spans(spark, sf), CELL, how="left")
    return joined.groupBy("gid", "frame").agg(F.coalesce(F.min_by("v", "ord"), F.lit(-1.0)).alias("v"))


@query("q_cover_stats", f"WITH {SPANS_SQL}, {GRID_SQL} SELECT grid.gid, frame, count(v) AS n, coalesce(max(v), -5.0) AS most, round(coalesce(avg(v), -12.0), 6) AS mean, coalesce(bool_or(v > 50), false) AS any_high FROM grid LEFT JOIN spans s ON s.gid = grid.gid AND t >= s.start AND t < s.\"end\" GROUP BY grid.gid, frame")
def cover_stats(spark, sf):
    """Per frame: spans that cover it, their largest and mean value with defaults, whether any is high."""
    joined = I.points_in_spans(grid(spark, sf), spans(spark, sf), CELL, how="left")
    return joined.groupBy("gid", "frame").agg(F.count("v").alias("n"), F.coalesce(F.max("v"), F.lit(-5.0)).alias("most"), F.round(F.coalesce(F.avg("v"), F.lit(-12.0)), 6).alias("mean"), F.coalesce(F.bool_or(F.col("v") > 50), F.lit(False)).alias("any_high"))


@query(
    "q_index_raster",
    f"""WITH {SPANS_SQL}, f AS (SELECT gid, v, greatest(ceil(least(start, "end") / 4 - 1e-9), 0)::BIGINT AS a, least(ceil(greatest(start, "end") / 4 - 1e-9), len({cells_sql(FRAME_HOURS)}))::BIGINT AS b FROM spans)
    SELECT gid, i AS frame, max(v) AS v FROM f, LATERAL (SELECT unnest(range(a, b)) AS i) GROUP BY gid, i""",
)
def index_raster(spark, sf):
    """Spans as ranges of frame numbers, edges by ceil with a tolerance, reversed ones swapped, clamped to the grid."""
    a = F.greatest(F.ceil(F.least("start", "end") / FRAME_HOURS - 1e-9), F.lit(0)).cast("long")
    b = F.least(F.ceil(F.greatest("start", "end") / FRAME_HOURS - 1e-9), F.lit(n_cells(spark, sf, FRAME_HOURS))).cast("long")
    f = spans(spark, sf).select("gid", "v", a.alias("a"), b.alias("b")).where("b > a")
    return f.select("gid", "v", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("frame")).groupBy("gid", "frame").agg(F.max("v").alias("v"))


@query("q_points_in_windows", f"WITH {CURVE_SQL} SELECT gid, greatest(least(floor(t / 100), ceil({DURATION_SQL} / 100) - 1), 0)::BIGINT AS w, count(*) AS n, round(avg(s), 6) AS mean FROM curve GROUP BY ALL")
def points_in_windows(spark, sf):
    """Points of half-open windows, the last one closed at the last event."""
    last = max(0, math.ceil(duration(spark, sf) / 100) - 1)
    return curve(spark, sf).groupBy("gid", F.least(F.floor(F.col("t") / 100), F.lit(last)).alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean"))


@query(
    "q_window_labels",
    f"""WITH {CURVE_SQL}, w AS (SELECT gid, floor(t / 72)::BIGINT AS w, avg(y) AS m FROM curve GROUP BY ALL) SELECT gid, w, CASE WHEN m >= 0.5 THEN 1 WHEN m = 0 THEN 0 END AS label FROM w""",
)
def window_labels(spark, sf):
    m = curve(spark, sf).groupBy("gid", F.floor(F.col("t") / 72).alias("w")).agg(F.avg("y").alias("m"))
    return m.select("gid", "w", F.when(F.col("m") >= 0.5, 1).when(F.col("m") == 0, 0).alias("label"))


@query(
    "q_gold_envelope_iou",
    f"""WITH {CURVE_SQL}, e AS (SELECT gid, min(t) FILTER (y = 1) AS a, max(t) FILTER (y = 1) AS b, min(t) FILTER (s > 60) AS c, max(t) FILTER (s > 60) AS d FROM curve GROUP BY gid)
    SELECT gid, round(a, 6) AS a, round(b, 6) AS b, round(CASE WHEN greatest(b, d) - least(a, c) > 0 THEN greatest(0, least(b, d) - greatest(a, c)) / (greatest(b, d) - least(a, c)) ELSE 0 END, 6) AS iou FROM e WHERE a IS NOT NULL AND c IS NOT NULL""",
)
def gold_envelope_iou(spark, sf):
    e = curve(spark, sf).groupBy("gid").agg(*[f(F.when(on, F.col("t"))).alias(n) for n, f, on in (("a", F.min, F.col("y") == 1), ("b", F.max, F.col("y") == 1), ("c", F.min, F.col("s") > 60), ("d", F.max, F.col("s") > 60))])
    return e.where("a is not null and c is not null").select("gid", *_r("a", "b"), F.round(I.iou(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 6).alias("iou"))


@query("q_mask_iou", f"WITH {CURVE_SQL} SELECT gid, round(count(*) FILTER (y = 1 AND s > 50) / nullif(count(*) FILTER (y = 1 OR s > 50), 0), 6) AS iou FROM curve GROUP BY gid")
def mask_iou(spark, sf):
    return curve(spark, sf).groupBy("gid").agg(F.round(F.count_if((F.col("y") == 1) & (F.col("s") > 50)) / F.nullif(F.count_if((F.col("y") == 1) | (F.col("s") > 50)), F.lit(0)), 6).alias("iou"))

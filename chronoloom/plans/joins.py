"""Queries on range, as-of and matching joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.operators import asof as A
from chronoloom.operators import intervals as I
from chronoloom.plans.catalog import query
from chronoloom.plans.frames import CURVE_SQL, FRAME_HOURS, GRID_SQL, SPANS_SQL, cells_sql, curve, grid, n_cells, read, spans

CELL = 24.0
_SAMPLES = "samples AS (SELECT gid, t, s AS v FROM curve)"


def _samples(spark, sf):
    return curve(spark, sf).select("gid", "t", F.col("s").alias("v"))


@query("q_units_asof", f"WITH {CURVE_SQL}, {_SAMPLES}, {GRID_SQL}, f AS (SELECT gid, arg_min(v, t) AS v FROM samples GROUP BY gid) SELECT g.gid, g.frame, coalesce(s.v, f.v) AS v FROM (SELECT *, t + 2.0 AS c FROM grid) g JOIN f USING (gid) ASOF LEFT JOIN samples s ON g.gid = s.gid AND g.c >= s.t")
def units_asof(spark, sf):
    """Last sample before each frame's centre; before the first sample, that one."""
    s = _samples(spark, sf)
    points = grid(spark, sf).select("gid", "frame", (F.col("t") + FRAME_HOURS / 2).alias("t"))
    first = s.groupBy("gid").agg(F.min_by("v", "t").alias("first"))
    return A.asof(points, s, CELL).join(first, "gid").select("gid", "frame", F.coalesce("found.v", "first").alias("v"))


@query("q_forward_asof", f"WITH {CURVE_SQL}, {_SAMPLES}, {GRID_SQL} SELECT g.gid, g.frame, s.v FROM grid g ASOF LEFT JOIN samples s ON g.gid = s.gid AND g.t <= s.t")
def forward_asof(spark, sf):
    """First sample at or after each frame; null past the end."""
    return A.asof(grid(spark, sf), _samples(spark, sf), CELL, ahead=True).select("gid", "frame", "found.v")


@query("q_samples_nearest", f"WITH {CURVE_SQL}, {_SAMPLES}, {GRID_SQL} SELECT g.gid, g.frame, arg_min(s.v, (abs(s.t - g.t), s.t)) AS v FROM grid g JOIN samples s USING (gid) GROUP BY g.gid, g.frame")
def samples_nearest(spark, sf):
    return A.nearest(grid(spark, sf), _samples(spark, sf), CELL).select("gid", "frame", "found.v")


_DST = f"dst AS (SELECT gid, i AS w, (i * 31.0)::DOUBLE AS a, ((i + 1) * 31.0)::DOUBLE AS b FROM (SELECT DISTINCT gid FROM spans), (SELECT unnest({cells_sql(31.0)}) AS i))"


def _dst(spark, sf):
    ids = spans(spark, sf).select("gid").distinct()
    w = F.explode(F.sequence(F.lit(0), F.lit(n_cells(spark, sf, 31.0) - 1))).alias("w")
    return ids.select("gid", w).select("gid", "w", (F.col("w") * 31.0).alias("a"), ((F.col("w") + 1) * 31.0).alias("b"))


@query(
    "q_overlap_resample",
    f"""WITH {SPANS_SQL}, {_DST}, o AS (SELECT dst.gid, w, sum(v * (least(b, "end") - greatest(a, start))) AS vw, sum(least(b, "end") - greatest(a, start)) AS wt FROM dst JOIN spans s ON s.gid = dst.gid AND s.start < b AND s."end" > a GROUP BY ALL),
    n AS (SELECT dst.gid, w, arg_min(v, (greatest(start - b, a - "end"), ord)) AS near FROM dst JOIN spans USING (gid) GROUP BY ALL)
    SELECT n.gid, n.w, round(CASE WHEN wt > 0 THEN vw / wt ELSE near END, 6) AS v FROM n LEFT JOIN o USING (gid, w)""",
)
def overlap_resample(spark, sf):
    """Mean of the spans that overlap a window, weighted by overlap; without one, the nearest span's value."""
    src, dst = spans(spark, sf), _dst(spark, sf)
    weighed = I.overlaps(dst, src, CELL).groupBy("gid", "w").agg((F.sum(F.col("v") * F.col("overlap")) / F.sum("overlap")).alias("v"))
    joined = dst.join(weighed, ["gid", "w"], "left")
    # the nearest span begins next after the window or, of those that end before it, ends last
    bare = joined.where("v is null").select("gid", "w", "a", "b")
    gap_next = A.asof(bare.withColumn("t", F.col("b")), src.select("gid", F.col("start").alias("t"), F.col("ord").cast("double").alias("v")), CELL * 4, ahead=True).select("gid", "w", "a", "b", F.col("found").alias("next"))
    ends = src.select("gid", F.col("end").alias("t"), (-F.col("ord")).cast("double").alias("v"))
    both = A.asof(gap_next.withColumn("t", F.col("a")), ends, CELL * 4).select("gid", "w", "a", "b", "next", F.col("found").alias("prev"))
    gap = lambda x: F.coalesce(x, F.lit(float("inf")))
    after, before = F.struct(gap(F.col("next.t") - F.col("b")).alias("d"), F.coalesce("next.v", F.lit(float("inf"))).alias("ord")), F.struct(gap(F.col("a") - F.col("prev.t")).alias("d"), F.coalesce(-F.col("prev.v"), F.lit(float("inf"))).alias("ord"))
    chosen = both.select("gid", "w", F.least(after, before)["ord"].cast("long").alias("ord"))
    near = chosen.join(src.select("gid", "ord", F.col("v").alias("near")), ["gid", "ord"]).select("gid", "w", "near")
    return joined.select("gid", "w", "v").join(near, ["gid", "w"], "left").select("gid", "w", F.round(F.coalesce("v", "near"), 6).alias("v"))


@query("q_overlap_bins", f"WITH {SPANS_SQL}, {_DST} SELECT dst.gid, w, round(sum(v * (least(b, \"end\") - greatest(a, start)) / (\"end\" - start)), 6) AS weight, round(sum(least(b, \"end\") - greatest(a, start)) / 31.0, 6) AS density FROM dst JOIN spans s ON s.gid = dst.gid AND s.start < b AND s.\"end\" > a GROUP BY ALL")
def overlap_bins(spark, sf):
    """Weights of spans spread over the bins they cover, and how densely these are covered."""
    o = I.overlaps(_dst(spark, sf), spans(spark, sf), CELL)
    return o.groupBy("gid", "w").agg(F.round(F.sum(F.col("v") * F.col("overlap") / (F.col("end") - F.col("start"))), 6).alias("weight"), F.round(F.sum("overlap") / 31.0, 6).alias("density"))


@query("q_window_cells", f"WITH {SPANS_SQL}, c AS (SELECT gid, ord, unnest(range(floor(start / 10)::BIGINT, greatest(ceil((\"end\" - 1e-6) / 10), floor(start / 10) + 1)::BIGINT)) AS cell FROM spans) SELECT gid, cell, count(*) AS n FROM c GROUP BY ALL")
def window_cells(spark, sf):
    """Cells that spans cover by more than a millionth; at least the cell they start in."""
    first = F.floor(F.col("start") / 10).cast("long")
    last = F.greatest(F.ceil((F.col("end") - 1e-6) / 10).cast("long"), first + 1)
    return spans(spark, sf).select("gid", F.explode(F.sequence(first, last - 1)).alias("cell")).groupBy("gid", "cell").agg(F.count("*").alias("n"))


@query("q_sample_and_hold", f"WITH {CURVE_SQL}, n AS (SELECT gid, count(*) AS n FROM curve GROUP BY gid), f AS (SELECT unnest({cells_sql(FRAME_HOURS)}) AS frame), g AS (SELECT gid, frame, least(frame // 4, n - 1) AS idx FROM n, f) SELECT g.gid, frame, s FROM g JOIN curve c ON c.gid = g.gid AND c.idx = g.idx")
def sample_and_hold(spark, sf):
    """A curve of a lower rate held over a finer grid, its last sample held to the end."""
    c = curve(spark, sf)
    n = c.groupBy("gid").agg(F.count("*").alias("n")).select("gid", "n", F.explode(F.sequence(F.lit(0), F.lit(n_cells(spark, sf, FRAME_HOURS) - 1))).alias("frame"))
    at = n.select("gid", "frame", F.least(F.floor(F.col("frame") / 4), F.col("n") - 1).alias("idx"))
    return at.join(c, ["gid", "idx"]).select("gid", "frame", "s")


@query("q_resize_nearest", f"WITH {CURVE_SQL}, n AS (SELECT gid, count(*) AS n FROM curve GROUP BY gid) SELECT n.gid, f AS i, s FROM n, range(50) r(f) JOIN curve c ON c.gid = n.gid AND c.idx = least(floor(f * n / 50), n.n - 1)")
def resize_nearest(spark, sf):
    c = curve(spark, sf)
    n = c.groupBy("gid").agg(F.count("*").alias("n")).select("gid", "n", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i"))
    at = n.select("gid", "i", F.least(F.floor(F.col("i") * F.col("n") / 50), F.col("n") - 1).alias("idx"))
    return at.join(c, ["gid", "idx"]).select("gid", "i", "s")


@query(
    "q_fill_nearest",
    f"""WITH {CURVE_SQL}, h AS (SELECT gid, idx, CASE WHEN event_type <> 'click' THEN s END AS s FROM curve),
    k AS (SELECT a.gid, a.idx, arg_min(b.s, (abs(b.idx - a.idx), b.idx)) AS s FROM h a JOIN h b ON a.gid = b.gid AND b.s IS NOT NULL GROUP BY ALL) SELECT * FROM k""",
)
def fill_nearest(spark, sf):
    """Missing values from the nearest present one; the lower position of two."""
    o = W.partitionBy("gid").orderBy("idx")
    held = F.when((F.col("event_type") != "click"), F.struct(F.col("idx").alias("i"), F.col("s").alias("s")))
    h = curve(spark, sf).select("gid", "idx", held.alias("h"))
    both = h.select("gid", "idx", F.last("h", ignorenulls=True).over(o.rowsBetween(W.unboundedPreceding, 0)).alias("b"), F.first("h", ignorenulls=True).over(o.rowsBetween(0, W.unboundedFollowing)).alias("f"))
    nearer = F.col("b").isNull() | (F.col("f.i") - F.col("idx") < F.col("idx") - F.col("b.i"))
    return both.where("b is not null or f is not null").select("gid", "idx", F.when(nearer & F.col("f").isNotNull(), F.col("f.s")).otherwise(F.col("b.s")).alias("s"))


@query("q_pooled_join", "SELECT d.doc_id, n_chars, quality FROM documents d JOIN labels l USING (doc_id) WHERE isfinite(n_chars::DOUBLE)")
def pooled_join(spark, sf):
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").where("not isnan(cast(n_chars as double))").select("doc_id", "n_chars", "quality")


@query("q_coverage_report", "SELECT 'missing' AS kind, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'extra', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) UNION ALL SELECT 'bad', doc_id FROM labels WHERE quality NOT IN (0, 1)")
def coverage_report(spark, sf):
    d, l = read(spark, sf, "documents"), read(spark, sf, "labels")
    missing = d.join(l, "doc_id", "left_anti").select(F.lit("missing").alias("kind"), "doc_id")
    extra = l.join(d, "doc_id", "left_anti").select(F.lit("extra").alias("kind"), "doc_id")
    return missing.unionByName(extra).unionByName(l.where("quality not in (0, 1)").select(F.lit("bad").alias("kind"), "doc_id"))


@query("q_boundary_pairs", f"WITH {CURVE_SQL}, w AS (SELECT gid, floor(t / 48)::BIGINT AS w, max(y) AS y, avg(s) AS m FROM curve GROUP BY ALL), p AS (SELECT *, lead(w) OVER o AS nw, lead(y) OVER o AS ny, lead(m) OVER o AS nm FROM w WINDOW o AS (PARTITION BY gid ORDER BY w)) SELECT gid, w, (y <> ny)::INT AS changed, round(abs(nm - m), 6) AS jump FROM p WHERE nw = w + 1")
def boundary_pairs(spark, sf):
    """Adjacent windows and whether the label changes between them."""
    w = curve(spark, sf).groupBy("gid", F.floor(F.col("t") / 48).alias("w")).agg(F.max("y").alias("y"), F.avg("s").alias("m"))
    o = W.partitionBy("gid").orderBy("w")
    p = w.select("*", F.lead("w").over(o).alias("nw"), F.lead("y").over(o).alias("ny"), F.lead("m").over(o).alias("nm")).where("nw = w + 1")
    return p.select("gid", "w", (F.col("y") != F.col("ny")).cast("int").alias("changed"), F.round(F.abs(F.col("nm") - F.col("m")), 6).alias("jump"))


@query("q_common_keys", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT page_id FROM pages")
def common_keys(spark, sf):
    return read(spark, sf, "documents").select("doc_id").intersect(read(spark, sf, "labels").select("doc_id")).intersect(read(spark, sf, "pages").select(F.col("page_id").alias("doc_id")))


@query("q_live_spans", f"WITH {SPANS_SQL}, {GRID_SQL}, j AS (SELECT grid.gid, frame, ord, row_number() OVER (PARTITION BY grid.gid, frame ORDER BY s.start, ord) AS r FROM grid JOIN spans s ON s.gid = grid.gid AND t >= s.start AND t < s.\"end\") SELECT gid, frame, ord FROM j WHERE r <= 3")
def live_spans(spark, sf):
    """Up to three spans that are live at each frame, the oldest first."""
    j = I.points_in_spans(grid(spark, sf), spans(spark, sf), CELL)
    return j.withColumn("r", F.row_number().over(W.partitionBy("gid", "frame").orderBy("start", "ord"))).where("r <= 3").select("gid", "frame", "ord")

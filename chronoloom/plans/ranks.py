"""Queries on ranks and windowed sequences that SQL expresses."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.functions import scalars as S
from chronoloom.operators import ranks as R
from chronoloom.plans.catalog import query
from chronoloom.plans.frames import CURVE_SQL, curve, read

_MID = "mid AS (SELECT *, rank() OVER (PARTITION BY gid ORDER BY s) + (count(*) OVER (PARTITION BY gid, s) - 1) / 2.0 AS m, count(*) OVER (PARTITION BY gid) AS n FROM curve)"


@query("q_centered_midrank", f"WITH {CURVE_SQL}, {_MID}, c AS (SELECT *, (m - 0.5) / n - 0.5 AS r FROM mid) SELECT event_id, round(r, 9) AS r, round(r - avg(r) OVER (PARTITION BY gid), 9) AS recentred FROM c")
def centered_midrank(spark, sf):
    c = curve(spark, sf).select("gid", "event_id", R.centred_midrank("s", ["gid"]).alias("r"))
    return c.select("event_id", F.round("r", 9).alias("r"), F.round(F.col("r") - F.avg("r").over(W.partitionBy("gid")), 9).alias("recentred"))


@query("q_tied_ecdf", f"WITH {CURVE_SQL}, {_MID} SELECT event_id, round(CASE WHEN min(s) OVER (PARTITION BY gid) = max(s) OVER (PARTITION BY gid) THEN 0.5 ELSE (m - 1) / (n - 1) END, 9) AS u FROM mid")
def tied_ecdf(spark, sf):
    return curve(spark, sf).select("event_id", F.round(R.tied_ecdf("s", ["gid"]), 9).alias("u"))


@query("q_two_key_rank", f"WITH {CURVE_SQL} SELECT event_id, rank() OVER (PARTITION BY gid ORDER BY y, s) + (count(*) OVER (PARTITION BY gid, y, s) - 1) / 2.0 AS r FROM curve")
def two_key_rank(spark, sf):
    """Rank by a primary and a secondary key, ties averaged."""
    peers = F.count("*").over(W.partitionBy("gid", "y", "s"))
    return curve(spark, sf).select("event_id", (F.rank().over(W.partitionBy("gid").orderBy("y", "s")) + (peers - 1) / 2).alias("r"))


@query("q_empirical_cdf", f"WITH {CURVE_SQL} SELECT event_id, round(cume_dist() OVER (PARTITION BY gid ORDER BY s), 9) AS u FROM curve")
def empirical_cdf(spark, sf):
    return curve(spark, sf).select("event_id", F.round(F.cume_dist().over(W.partitionBy("gid").orderBy("s")), 9).alias("u"))


@query("q_lag_lead", f"WITH {CURVE_SQL} SELECT event_id, lag(s, 2) OVER w AS back, lead(s, 1) OVER w AS ahead FROM curve WINDOW w AS (PARTITION BY gid ORDER BY idx)")
def lag_lead(spark, sf):
    w = W.partitionBy("gid").orderBy("idx")
    return curve(spark, sf).select("event_id", F.lag("s", 2).over(w).alias("back"), F.lead("s", 1).over(w).alias("ahead"))


@query("q_moving_mean_centered", f"WITH {CURVE_SQL} SELECT event_id, round(avg(s) OVER (PARTITION BY gid ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS m FROM curve")
def moving_mean_centered(spark, sf):
    return curve(spark, sf).select("event_id", F.round(F.avg("s").over(W.partitionBy("gid").orderBy("idx").rowsBetween(-3, 3)), 6).alias("m"))


@query("q_moving_mean_valid", f"WITH {CURVE_SQL}, m AS (SELECT gid, idx, avg(s) OVER w AS m, count(*) OVER w AS n FROM curve WINDOW w AS (PARTITION BY gid ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT gid, idx, round(m, 6) AS m FROM m WHERE n = 5")
def moving_mean_valid(spark, sf):
    """Only windows that are full."""
    w = W.partitionBy("gid").orderBy("idx").rowsBetween(0, 4)
    return curve(spark, sf).select("gid", "idx", F.avg("s").over(w).alias("m"), F.count("*").over(w).alias("n")).where("n = 5").select("gid", "idx", F.round("m", 6).alias("m"))


_KERNEL = "kernel AS (SELECT k, exp(-0.5 * k * k / 4.0) / (SELECT sum(exp(-0.5 * j * j / 4.0)) FROM range(-4, 5) r(j)) AS w FROM range(-4, 5) t(k))"


@query("q_gaussian_smooth", f"WITH {CURVE_SQL}, {_KERNEL} SELECT a.gid, a.idx, round(sum(b.s * w), 6) AS v FROM curve a, kernel JOIN curve b ON b.gid = a.gid AND b.idx = a.idx + k GROUP BY a.gid, a.idx")
def gaussian_smooth(spark, sf):
    """Kernel sum with zeros beyond the ends: each position sends its weighted value to nine places, aggregated before the shuffle ends."""
    weights = [2.718281828459045 ** (-0.5 * k * k / 4) for k in range(-4, 5)]
    total = sum(weights)
    sent = F.explode(F.array(*[F.struct(F.lit(-k).alias("k"), F.lit(x / total).alias("w")) for k, x in zip(range(-4, 5), weights, strict=True)]))
    c = curve(spark, sf)
    parts = c.select("gid", "idx", "s", sent.alias("x")).select("gid", (F.col("idx") + F.col("x.k")).alias("idx"), (F.col("s") * F.col("x.w")).alias("p"))
    return parts.groupBy("gid", "idx").agg(F.sum("p").alias("v")).join(c, ["gid", "idx"], "left_semi").select("gid", "idx", F.round("v", 6).alias("v"))


@query("q_softmax", f"WITH {CURVE_SQL}, e AS (SELECT *, exp((s - max(s) OVER (PARTITION BY gid)) / 10) AS e FROM curve) SELECT event_id, round(e / sum(e) OVER (PARTITION BY gid), 9) AS p FROM e")
def softmax(spark, sf):
    g = W.partitionBy("gid")
    e = curve(spark, sf).withColumn("e", F.exp((F.col("s") - F.max("s").over(g)) / 10))
    return e.select("event_id", F.round(F.col("e") / F.sum("e").over(g), 9).alias("p"))


@query("q_minmax", f"WITH {CURVE_SQL} SELECT event_id, round(CASE WHEN max(s) OVER g > min(s) OVER g THEN (s - min(s) OVER g) / (max(s) OVER g - min(s) OVER g) ELSE 0 END, 9) AS v FROM curve WINDOW g AS (PARTITION BY gid)")
def minmax(spark, sf):
    g = W.partitionBy("gid")
    lo, hi = F.min("s").over(g), F.max("s").over(g)
    return curve(spark, sf).select("event_id", F.round(F.when(hi > lo, (F.col("s") - lo) / (hi - lo)).otherwise(0.0), 9).alias("v"))


@query("q_robust_unit", f"WITH {CURVE_SQL}, m AS (SELECT gid, median(s) AS m FROM curve GROUP BY gid), d AS (SELECT gid, any_value(m) AS m, 1.4826 * median(abs(s - m)) AS mad, sqrt(avg(pow(s - m, 2))) AS rms FROM curve JOIN m USING (gid) GROUP BY gid) SELECT event_id, round((s - m) / CASE WHEN mad > 1e-12 THEN mad WHEN rms > 1e-12 THEN rms ELSE 1 END, 6) AS z FROM curve JOIN d USING (gid)")
def robust_unit(spark, sf):
    return R.robust_unit(curve(spark, sf).select("gid", "event_id", "s"), "s", ["gid"], "z").select("event_id", F.round("z", 6).alias("z"))


@query("q_standardize", f"WITH {CURVE_SQL} SELECT event_id, round((s - avg(s) OVER g) / CASE WHEN stddev_pop(s) OVER g > 0 THEN stddev_pop(s) OVER g ELSE 1 END, 6) AS z FROM curve WINDOW g AS (PARTITION BY event_type)")
def standardize(spark, sf):
    c = curve(spark, sf)
    g = c.groupBy("event_type").agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("sd"))
    return c.join(g, "event_type").select("event_id", F.round((F.col("s") - F.col("m")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0), 6).alias("z"))


@query("q_position_weight", f"WITH {CURVE_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY gid) // 2 AS half FROM curve) SELECT event_id, round(CASE WHEN half >= 1 THEN s * exp(-0.5 * pow((idx - half) / half, 2)) ELSE s END, 9) AS v FROM n")
def position_weight(spark, sf):
    """A normal curve around the middle position, half the length wide; one value alone stays."""
    half = F.floor(F.count("*").over(W.partitionBy("gid")) / 2)
    c = curve(spark, sf).select("event_id", "idx", "s", half.alias("half"))
    return c.select("event_id", F.round(F.when(F.col("half") >= 1, F.col("s") * F.exp(-0.5 * ((F.col("idx") - F.col("half")) / F.col("half")) ** 2)).otherwise(F.col("s")), 9).alias("v"))


@query("q_vector_divergence", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) SELECT vec_id, round(1 - list_dot_product(e, p) / sqrt(list_dot_product(e, e) * list_dot_product(p, p)), 6) AS d FROM v WHERE p IS NOT NULL")
def vector_divergence(spark, sf):
    """Cosine distance of consecutive vectors."""
    v = read(spark, sf, "embeddings").select("vec_id", "embedding", F.lag("embedding").over(W.partitionBy("label").orderBy("vec_id")).alias("p")).where("p is not null")
    return v.select("vec_id", F.round(1 - S.cosine(F.col("embedding"), F.col("p")), 6).alias("d"))


@query(
    "q_merge_boundaries",
    f"""WITH {CURVE_SQL}, b AS (SELECT gid, idx, coalesce(idx - lag(idx) OVER (PARTITION BY gid ORDER BY idx) >= 4, true)::INT AS new FROM curve WHERE s > 70), c AS (SELECT *, sum(new) OVER (PARTITION BY gid ORDER BY idx ROWS UNBOUNDED PRECEDING) AS k FROM b)
    SELECT gid, max(idx) AS boundary FROM c GROUP BY gid, k""",
)
def merge_boundaries(spark, sf):
    """Boundaries closer than four positions become one, the last."""
    o = W.partitionBy("gid").orderBy("idx")
    b = curve(spark, sf).where("s > 70").select("gid", "idx", F.coalesce(F.col("idx") - F.lag("idx").over(o) >= 4, F.lit(True)).cast("int").alias("new"))
    return b.withColumn("k", F.sum("new").over(o)).groupBy("gid", "k").agg(F.max("idx").alias("boundary")).drop("k")


@query(
    "q_partition_events",
    f"""WITH {CURVE_SQL}, n AS (SELECT gid, count(*) AS n FROM curve GROUP BY gid), b AS (SELECT gid, 0 AS start FROM n UNION SELECT gid, idx FROM curve WHERE s > 80 AND idx > 0)
    SELECT gid, start, coalesce(lead(start) OVER (PARTITION BY gid ORDER BY start), n) AS "end" FROM b JOIN n USING (gid)""",
)
def partition_events(spark, sf):
    """Boundaries to the events between them, from the first position to the last."""
    c = curve(spark, sf)
    n = c.groupBy("gid").agg(F.count("*").alias("n"))
    b = n.select("gid", F.lit(0).cast("int").alias("start")).union(c.where("s > 80 and idx > 0").select("gid", "idx"))
    nxt = F.lead("start").over(W.partitionBy("gid").orderBy("start"))
    return b.join(n, "gid").select("gid", "start", F.coalesce(nxt, F.col("n")).alias("end"))


@query(
    "q_local_peaks",
    f"""WITH {CURVE_SQL}, q AS (SELECT gid, quantile_cont(s, 0.75) AS q FROM curve GROUP BY gid), l AS (SELECT *, max(s) OVER (PARTITION BY gid ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM curve)
    SELECT gid, idx, s FROM l JOIN q USING (gid) WHERE s = m AND s >= q""",
)
def local_peaks(spark, sf):
    c = curve(spark, sf)
    m = F.max("s").over(W.partitionBy("gid").orderBy("idx").rowsBetween(-1, 1))
    q = c.groupBy("gid").agg(F.percentile("s", 0.75).alias("q"))
    return c.withColumn("m", m).join(q, "gid").where("s = m and s >= q").select("gid", "idx", "s")


@query(
    "q_interpolate_centres",
    f"""WITH {CURVE_SQL}, k AS (SELECT gid, idx // 5 AS k, avg(s) AS v FROM curve GROUP BY ALL), m AS (SELECT gid, max(k) AS last FROM k GROUP BY gid),
    p AS (SELECT c.gid, idx, greatest(least((idx - 2) / 5.0, last), 0) AS x, last FROM curve c JOIN m USING (gid))
    SELECT p.gid, idx, round(a.v + (b.v - a.v) * (x - floor(x)), 6) AS v FROM p JOIN k a ON a.gid = p.gid AND a.k = floor(x) JOIN k b ON b.gid = p.gid AND b.k = least(floor(x) + 1, last)""",
)
def interpolate_centres(spark, sf):
    """Means of blocks of five, interpolated linearly between block centres, flat at the ends."""
    c = curve(spark, sf)
    k = c.groupBy("gid", F.floor(F.col("idx") / 5).alias("k")).agg(F.avg("s").alias("v"))
    o = W.partitionBy("gid").orderBy("k")
    steps = k.select("gid", "k", "v", F.coalesce(F.lead("v").over(o), "v").alias("next"), F.max("k").over(W.partitionBy("gid")).alias("last"))
    x = F.greatest(F.least((F.col("idx") - 2) / 5, F.col("last").cast("double")), F.lit(0.0))
    m = k.groupBy("gid").agg(F.max("k").alias("last"))
    p = c.join(m, "gid").select("gid", "idx", x.alias("x")).withColumn("k", F.floor("x"))
    return p.join(steps.drop("last"), ["gid", "k"]).select("gid", "idx", F.round(F.col("v") + (F.col("next") - F.col("v")) * (F.col("x") - F.col("k")), 6).alias("v"))


@query("q_weighted_quantiles", f"WITH {CURVE_SQL}, c AS (SELECT gid, idx, sum(s) OVER (PARTITION BY gid ORDER BY idx ROWS UNBOUNDED PRECEDING) / sum(s) OVER (PARTITION BY gid) AS c FROM curve) SELECT gid, k::INT AS k, min(idx) FILTER (c >= (k + 0.5) / 5 - 1e-12) AS idx FROM c, range(5) r(k) GROUP BY gid, k")
def weighted_quantiles(spark, sf):
    """Positions at five equally likely places of the mass of a curve."""
    o = W.partitionBy("gid").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    c = curve(spark, sf).select("gid", "idx", (F.sum("s").over(o) / F.sum("s").over(W.partitionBy("gid"))).alias("c"))
    at = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")
    return c.select("gid", "idx", "c", at).groupBy("gid", "k").agg(F.min(F.when(F.col("c") >= (F.col("k") + 0.5) / 5 - 1e-12, F.col("idx"))).alias("idx"))


@query(
    "q_concordance",
    f"""WITH {CURVE_SQL}, a0 AS (SELECT *, s - median(s) OVER (PARTITION BY gid) AS c_a FROM curve), a AS (SELECT *, c_a / greatest(1.4826 * median(abs(c_a)) OVER (PARTITION BY gid), 1e-300) AS u_a FROM a0), b0 AS (SELECT *, t - median(t) OVER (PARTITION BY gid) AS c_b FROM a), b AS (SELECT *, c_b / greatest(1.4826 * median(abs(c_b)) OVER (PARTITION BY gid), 1e-300) AS u_b FROM b0),
    z AS (SELECT gid, event_id, CASE WHEN sign(u_a) = sign(u_b) THEN sign(u_a) * least(abs(u_a), abs(u_b)) ELSE 0 END AS v FROM b), c0 AS (SELECT *, v - median(v) OVER (PARTITION BY gid) AS c_c FROM z), c AS (SELECT *, c_c / greatest(1.4826 * median(abs(c_c)) OVER (PARTITION BY gid), 1e-300) AS u_c FROM c0), w AS (SELECT *, 1.4826 * median(abs(c_c)) OVER (PARTITION BY gid) AS mad, sqrt(avg(c_c * c_c) OVER (PARTITION BY gid)) AS rms FROM c)
    SELECT event_id, round(CASE WHEN mad > 1e-12 THEN c_c / mad WHEN rms > 1e-12 THEN c_c / rms ELSE 0 END, 6) AS v FROM w""",
)
def concordance(spark, sf):
    """The smaller of two robust deviations where their signs agree, else 0, in robust units again."""
    c = curve(spark, sf).select("gid", "event_id", "s", "t")
    z = R.robust_unit(R.robust_unit(c, "s", ["gid"], "a"), "t", ["gid"], "b")
    agreed = F.when(F.signum("a") == F.signum("b"), F.signum("a") * F.least(F.abs("a"), F.abs("b"))).otherwise(0.0)
    return R.robust_unit(z.select("gid", "event_id", agreed.alias("v")), "v", ["gid"], "v").select("event_id", F.round("v", 6).alias("v"))


@query("q_haar_details", f"WITH {CURVE_SQL}, p AS (SELECT gid, idx // 2 AS k, max(s) FILTER (idx % 2 = 0) AS a, max(s) FILTER (idx % 2 = 1) AS b FROM curve GROUP BY ALL), d AS (SELECT gid, k, (a - b) / sqrt(2) AS d FROM p WHERE b IS NOT NULL), m AS (SELECT gid, median(abs(d)) / 0.6745 AS sigma, count(*) AS n FROM d GROUP BY gid) SELECT gid, k, round(sign(d) * greatest(abs(d) - sigma * sqrt(2 * ln(n)), 0), 6) AS d FROM d JOIN m USING (gid)")
def haar_details(spark, sf):
    """First-level Haar details under the universal soft threshold."""
    p = curve(spark, sf).groupBy("gid", F.floor(F.col("idx") / 2).alias("k")).agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("s"))).alias("a"), F.max(F.when(F.col("idx") % 2 == 1, F.col("s"))).alias("b"))
    d = p.where("b is not null").select("gid", "k", ((F.col("a") - F.col("b")) / F.sqrt(F.lit(2.0))).alias("d"))
    m = d.groupBy("gid").agg((F.median(F.abs("d")) / 0.6745).alias("sigma"), F.count("*").alias("n"))
    soft = F.signum("d") * F.greatest(F.abs("d") - F.col("sigma") * F.sqrt(2 * F.log("n")), F.lit(0.0))
    return d.join(m, "gid").select("gid", "k", F.round(soft, 6).alias("d"))


@query("q_autocorrelation", f"WITH {CURVE_SQL}, c AS (SELECT gid, idx, s - avg(s) OVER (PARTITION BY gid) AS x FROM curve), v AS (SELECT gid, sum(x * x) AS v FROM c GROUP BY gid) SELECT a.gid, (b.idx - a.idx)::INT AS lag, round(sum(a.x * b.x) / any_value(v), 6) AS r FROM c a JOIN c b ON a.gid = b.gid AND b.idx - a.idx BETWEEN 1 AND 5 JOIN v ON v.gid = a.gid GROUP BY ALL")
def autocorrelation(spark, sf):
    """Lags 1 to 5, read through a window and not a self-join."""
    o = W.partitionBy("gid").orderBy("idx")
    c = curve(spark, sf).select("gid", "idx", (F.col("s") - F.avg("s").over(W.partitionBy("gid"))).alias("x"))
    ahead = c.select("gid", "x", *[F.lead("x", k).over(o).alias(f"x{k}") for k in range(1, 6)])
    sums = ahead.groupBy("gid").agg(F.sum(F.col("x") * F.col("x")).alias("v"), *[F.sum(F.col("x") * F.col(f"x{k}")).alias(f"c{k}") for k in range(1, 6)])
    lags = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"c{k}") / F.col("v")).alias("r")) for k in range(1, 6)])).alias("l")
    return sums.select("gid", lags).where("l.r is not null").select("gid", "l.lag", F.round("l.r", 6).alias("r"))

"""Queries on unsupervised thresholds, mixtures and iterative estimates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.operators import thresholds as T
from chronoloom.plans.catalog import query
from chronoloom.plans.frames import CURVE_SQL, curve, points, shares


@query("q_otsu_threshold", f"WITH {CURVE_SQL}, r AS (SELECT min(s) AS lo, max(s) AS hi, count(*) AS n FROM curve), g AS (SELECT i, lo + (hi - lo) * i / 199 AS lim FROM r, range(200) x(i)), v AS (SELECT i, lim, count(*) FILTER (s < lim) AS n0, count(*) FILTER (s >= lim) AS n1, var_pop(s) FILTER (s < lim) AS v0, var_pop(s) FILTER (s >= lim) AS v1 FROM g, curve GROUP BY i, lim) SELECT round(arg_min(lim, (round((n0 * v0 + n1 * v1) / (n0 + n1), 9), i)), 6) AS threshold FROM v WHERE n0 > 0 AND n1 > 0")
def otsu_threshold(spark, sf):
    """Least within-class variance on a grid of 200 thresholds. The values are first summed between neighbouring thresholds, so the grid meets 200 rows and not the data."""
    c = curve(spark, sf).select("s")
    r = c.agg(F.min("s").alias("lo"), F.max("s").alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    grid = [lo + (hi - lo) * i / 199 for i in range(200)]
    near = F.least(F.greatest(F.floor((F.col("s") - lo) / ((hi - lo) or 1.0) * 199), F.lit(0)), F.lit(198)).cast("int")
    t = F.array(*[F.lit(x) for x in grid])
    # thresholds at or below s: the estimate from its place, put right where rounding moved it
    k = near + F.when(F.col("s") >= F.get(t, near + 1), 2).when(F.col("s") >= F.get(t, near), 1).otherwise(0)
    sums = c.groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.sum("s").alias("x"), F.sum(F.col("s") ** 2).alias("q"))
    up = W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)  # 200 rows at most
    at = spark.range(200).select(F.col("id").cast("int").alias("k")).join(sums, "k", "left").na.fill(0)
    below = at.select("k", *[F.sum(x).over(up).alias(x) for x in ("n", "x", "q")])
    whole = sums.agg(*[F.sum(x).alias(f"{x}t") for x in ("n", "x", "q")])
    both = below.withColumn("j", F.lit(1)).join(F.broadcast(whole.withColumn("j", F.lit(1))), "j")  # one row
    n1 = F.col("nt") - F.col("n")
    within = (F.col("q") - F.col("x") ** 2 / F.col("n") + (F.col("qt") - F.col("q")) - (F.col("xt") - F.col("x")) ** 2 / n1) / F.col("nt")
    best = both.where((F.col("n") > 0) & (n1 > 0)).agg(F.min_by("k", F.struct(F.round(within, 9), "k")).alias("k"))
    return best.select(F.round(lo + (hi - lo) * F.col("k") / 199, 6).alias("threshold"))


@query(
    "q_mad_quantile",
    f"""WITH {CURVE_SQL}, p AS (SELECT event_type, s / 2000 AS s FROM curve), m AS (SELECT event_type, median(s) AS m FROM p GROUP BY event_type), d AS (SELECT event_type, any_value(m) AS m, median(abs(s - m)) AS mad, count(*) AS n FROM p JOIN m USING (event_type) GROUP BY event_type),
    q AS (SELECT event_type, mad, least(greatest(0.6 + 7.83 * mad, 0.01), 0.99)::DOUBLE AS q, n FROM d), r AS (SELECT event_type, s, row_number() OVER (PARTITION BY event_type ORDER BY s) - 1 AS r FROM p),
    e AS (SELECT event_type, mad, q, max(s) FILTER (r = floor(q * (n - 1))) AS lo, max(s) FILTER (r = ceil(q * (n - 1))) AS hi, q * (n - 1) - floor(q * (n - 1)) AS f FROM r JOIN q USING (event_type) GROUP BY event_type, mad, q, n)
    SELECT event_type, round(mad, 9) AS mad, round(q, 9) AS q, round(lo + f * (hi - lo), 9) AS threshold FROM e""",
)
def mad_quantile(spark, sf):
    return T.mad_quantile(curve(spark, sf).withColumn("s", F.col("s") / 2000), "s", "event_type").select("event_type", *[F.round(c, 9).alias(c) for c in ("mad", "q", "threshold")])


@query("q_histogram_thresholds")
def histogram_thresholds(spark, sf):
    """Thresholds in shares of the range of all values, as five of the methods count chances alone."""
    t = T.histogram_thresholds(shares(points(spark, sf)).select("p"), "p")
    return spark.createDataFrame([(name, round(x, 6)) for name, x in t.items()], "method string, threshold double")


@query(
    "q_exact_splits",
    f"""WITH {CURVE_SQL}, r AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS r, min(s) OVER () AS lo, max(s) OVER () AS hi, count(*) OVER () AS n FROM curve), k AS (SELECT s FROM r ORDER BY round(abs(s - lo - (hi - lo) * r / (n - 1)), 9) DESC, r LIMIT 1),
    c AS (SELECT s, count(*) AS n, sum(s) AS m FROM curve GROUP BY s), w AS (SELECT s, lag(s) OVER o AS prev, sum(n) OVER o - n AS nb, sum(m) OVER o - m AS mb, sum(n) OVER () AS na, sum(m) OVER () AS ma FROM c WINDOW o AS (ORDER BY s)),
    g AS (SELECT (s + prev) / 2 AS t FROM w WHERE nb >= 2 AND na - nb >= 2 ORDER BY round((ma - mb) / (na - nb) - mb / nb, 9) DESC, s LIMIT 1)
    SELECT 'knee' AS method, s AS threshold FROM k UNION ALL SELECT 'gap_split', t FROM g""",
)
def exact_splits(spark, sf):
    s = curve(spark, sf).select("s")
    return T.knee(s, "s").select(F.lit("knee").alias("method"), "threshold").unionByName(T.gap_split(s, "s").select(F.lit("gap_split").alias("method"), "threshold"))


@query("q_kde_valley")
def kde_valley(spark, sf):
    h, x = T.histogram(curve(spark, sf).withColumn("s", F.log1p("s")), "s", 512)
    v = T.kde_valley(h, x)
    return spark.createDataFrame([(k, None if y is None else round(float(y), 6)) for k, y in v.items()], "name string, value double")


@query("q_gaussian_mixture")
def gaussian_mixture(spark, sf):
    """Two components with own and with shared variance, their crossing and error."""
    rows = []
    for shared in (False, True):
        g = T.gaussian_mixture(curve(spark, sf).withColumn("s", F.log1p("s")), "s", shared, 25)
        at, error = T.crossing(g)
        rows += [(shared, k, round(v, 5)) for k, v in (g | {"crossing": at, "error": error}).items()]
    return spark.createDataFrame(rows, "shared boolean, name string, value double")


@query("q_power_transform", f"WITH {CURVE_SQL}, l AS (SELECT k, -2 + k * 0.25 AS lam FROM range(17) r(k)), y AS (SELECT k, lam, CASE WHEN abs(lam) < 1e-9 THEN ln(s + 1) ELSE (pow(s + 1, lam) - 1) / lam END AS y, ln(s + 1) AS j FROM curve, l), f AS (SELECT k, lam, -count(*) / 2.0 * ln(var_pop(y)) + (lam - 1) * sum(j) AS f FROM y GROUP BY k, lam) SELECT round(arg_max(lam, (round(f, 3), -k)), 6)::DOUBLE AS lambda FROM f")
def power_transform(spark, sf):
    """Yeo-Johnson power with the greatest likelihood on a grid, for non-negative values; all powers in one pass over the data."""
    lams = [-2 + k * 0.25 for k in range(17)]
    up = F.col("s") + 1
    moved = lambda a: F.log(up) if abs(a) < 1e-9 else (F.pow(up, F.lit(a)) - 1) / a
    r = curve(spark, sf).agg(F.count("*").alias("n"), F.sum(F.log(up)).alias("j"), *[F.var_pop(moved(a)).alias(f"v{k}") for k, a in enumerate(lams)]).first()
    fit = [round(-r["n"] / 2 * math.log(r[f"v{k}"]) + (a - 1) * r["j"], 3) for k, a in enumerate(lams)]
    return spark.createDataFrame([(lams[max(range(17), key=lambda k: (fit[k], -k))],)], "lambda double")


@query(
    "q_beta_moments",
    f"""WITH {CURVE_SQL}, m AS (SELECT event_type, sum(t * (s / 500)) / (sum(t) + 1e-12) AS m FROM curve GROUP BY event_type), v AS (SELECT event_type, any_value(m) AS m, sum(t * pow(s / 500 - m, 2)) / (sum(t) + 1e-12) AS v FROM curve JOIN m USING (event_type) GROUP BY event_type),
    c AS (SELECT event_type, least(greatest(m, 1e-4), 1 - 1e-4) AS m, v FROM v), k AS (SELECT event_type, m, m * (1 - m) / least(greatest(v, 1e-5), m * (1 - m) * 0.95) - 1 AS k FROM c)
    SELECT event_type, round(greatest(0.2, m * k), 6) AS a, round(greatest(0.2, (1 - m) * k), 6) AS b FROM k""",
)
def beta_moments(spark, sf):
    """Beta parameters from weighted moments, both kept inside what a beta can have."""
    c = curve(spark, sf).select("event_type", F.col("t").alias("w"), (F.col("s") / 500).alias("x"))
    total = F.sum("w") + 1e-12
    m = c.groupBy("event_type").agg((F.sum(F.col("w") * F.col("x")) / total).alias("m"))
    v = c.join(m, "event_type").groupBy("event_type").agg(F.first("m").alias("m"), (F.sum(F.col("w") * (F.col("x") - F.col("m")) ** 2) / total).alias("v"))
    v = v.withColumn("m", F.least(F.greatest("m", F.lit(1e-4)), F.lit(1 - 1e-4)))
    own = F.col("m") * (1 - F.col("m"))
    k = own / F.least(F.greatest("v", F.lit(1e-5)), own * 0.95) - 1
    return v.select("event_type", F.round(F.greatest(F.lit(0.2), F.col("m") * k), 6).alias("a"), F.round(F.greatest(F.lit(0.2), (1 - F.col("m")) * k), 6).alias("b"))


@query("q_dawid_skene")
def dawid_skene(spark, sf):
    """Two-class Dawid-Skene: event types vote by score on each series; sensitivities and specificities by EM over aggregated votes."""
    votes = curve(spark, sf).groupBy("gid", "event_type").agg((F.avg("s") > 50).cast("int").alias("v")).persist()
    judges = [r["event_type"] for r in T.bounded_rows(votes.select("event_type").distinct().orderBy("event_type"), 64)]
    wide = votes.groupBy("gid").pivot("event_type", judges).agg(F.max("v"))
    # series with equal votes are one pattern
    patterns = wide.groupBy(*judges).agg(F.count("*").alias("n")).persist()
    total = patterns.agg(F.sum("n")).first()[0] or 1
    pi, sens, spec = 0.5, dict.fromkeys(judges, 0.7), dict.fromkeys(judges, 0.7)
    safe = lambda p: min(max(p, 1e-3), 1 - 1e-3)
    for _ in range(15):
        one, zero = F.lit(math.log(safe(pi))), F.lit(math.log(1 - safe(pi)))
        for j in judges:
            v = F.col(f"`{j}`")
            one += F.when(v == 1, math.log(safe(sens[j]))).when(v == 0, math.log(1 - safe(sens[j]))).otherwise(0.0)
            zero += F.when(v == 0, math.log(safe(spec[j]))).when(v == 1, math.log(1 - safe(spec[j]))).otherwise(0.0)
        r = 1 / (1 + F.exp(zero - one))
        p = patterns.withColumn("r", r)
        sums = [F.sum(F.col("n") * F.col("r")).alias("r1")]
        for k, j in enumerate(judges):
            v = F.col(f"`{j}`")
            seen = v.isNotNull().cast("int") * F.col("n")
            sums += [F.sum(F.coalesce(v, F.lit(0)) * F.col("n") * F.col("r")).alias(f"a{k}"), F.sum(seen * F.col("r")).alias(f"b{k}"), F.sum((1 - F.coalesce(v, F.lit(1))) * F.col("n") * (1 - F.col("r"))).alias(f"c{k}"), F.sum(seen * (1 - F.col("r"))).alias(f"d{k}")]
        s = p.agg(*sums).first()
        pi = s["r1"] / total
        for k, j in enumerate(judges):
            sens[j], spec[j] = safe(s[f"a{k}"] / max(s[f"b{k}"], 1e-9)), safe(s[f"c{k}"] / max(s[f"d{k}"], 1e-9))
    patterns.unpersist()
    votes.unpersist()
    return spark.createDataFrame([(j, round(sens[j], 5), round(spec[j], 5)) for j in judges], "judge string, sensitivity double, specificity double")


@query("q_sequential_judges", f"WITH {CURVE_SQL}, v AS (SELECT gid, max(s) FILTER (event_type = 'view') AS a, max(s) FILTER (event_type = 'click') AS b, max(s) FILTER (event_type = 'signup') AS c FROM curve GROUP BY gid) SELECT gid, CASE WHEN coalesce(a, 0) > 150 THEN 1 WHEN coalesce(b, 0) > 150 THEN 2 WHEN coalesce(c, 0) > 150 THEN 3 ELSE 0 END AS stopped FROM v")
def sequential_judges(spark, sf):
    """Judges asked in order until one is sure."""
    v = curve(spark, sf).groupBy("gid").agg(*[F.max(F.when(F.col("event_type") == k, F.col("s"))).alias(k) for k in ("view", "click", "signup")])
    asked = F.array(*[F.coalesce(k, F.lit(0.0)) for k in ("view", "click", "signup")])
    fold = F.aggregate(asked, F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")), lambda a, x: F.struct((a["n"] + 1).alias("n"), F.when((a["stop"] == 0) & (x > 150), a["n"] + 1).otherwise(a["stop"]).alias("stop")), lambda a: a["stop"])
    return v.select("gid", fold.alias("stopped"))


@query("q_reliability_update", f"WITH {CURVE_SQL}, p AS (SELECT gid, sum(CASE WHEN s > 50 THEN ln(0.7 / 0.3) ELSE ln(0.3 / 0.7) END) AS z FROM curve GROUP BY gid) SELECT gid, round(1 / (1 + exp(-z)), 9) AS p FROM p")
def reliability_update(spark, sf):
    """Bayes updates by all judgements of a series, of equal reliability. The log-odds add up, so their order is indifferent and no list is built."""
    from chronoloom.functions import scalars as S

    z = F.sum(F.when(F.col("s") > 50, 1).otherwise(-1)) * math.log(0.7 / 0.3)
    return curve(spark, sf).groupBy("gid").agg(F.round(S.sigmoid(z), 9).alias("p"))

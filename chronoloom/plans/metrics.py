"""Queries on ranking metrics, decisions, summaries and tests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.functions import stats as T
from chronoloom.operators import metrics as M
from chronoloom.operators.quantiles import percentiles
from chronoloom.plans.catalog import query
from chronoloom.plans.frames import CURVE_SQL, SHARE_SQL, curve, points, read, shares


def _r(*names, n=9):
    return [F.round(x, n).alias(x) for x in names]


_LABELLED = "d AS (SELECT n_chars AS s, quality AS y, lang FROM documents JOIN labels USING (doc_id))"


def _labelled(spark, sf):
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select(F.col("n_chars").alias("s"), F.col("quality").alias("y"), "lang", "doc_id")


def _rank_sql(source: str, by: str) -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""c AS (SELECT {key}s, sum(y) AS pos, count(*) - sum(y) AS neg FROM {source} GROUP BY {key}s),
    k AS (SELECT *, sum(pos) OVER ({part} ORDER BY s DESC) AS pf, sum(neg) OVER ({part} ORDER BY s DESC) AS nf, sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS n FROM c),
    m AS (SELECT {key}sum(pos * (n - nf + neg / 2.0)) AS won, sum(pos * pf / (pf + nf)) AS prec, max(p) AS p, max(n) AS n FROM k {f'GROUP BY {by}' if by else ''}),
    r AS (SELECT {key}CASE WHEN p > 0 AND n > 0 THEN won / p / n END AS auc, CASE WHEN p > 0 AND n > 0 THEN prec / p END AS ap, p / (p + n) AS base_rate, p::BIGINT AS n_pos, n::BIGINT AS n_neg FROM m)"""


@query("q_pooled_metrics", f"WITH {_LABELLED}, {_rank_sql('d', '')} SELECT round(auc, 9) AS auc, round(ap, 9) AS ap, round(base_rate, 9) AS base_rate, n_pos, n_neg FROM r")
def pooled_metrics(spark, sf):
    return M.rank_metrics(_labelled(spark, sf), "s", "y").select(*_r("auc", "ap", "base_rate"), "n_pos", "n_neg")


@query("q_group_metrics", f"WITH {CURVE_SQL}, {_rank_sql('curve', 'gid')} SELECT gid, round(auc, 9) AS auc, round(ap, 9) AS ap, round(base_rate, 9) AS base_rate, n_pos, n_neg FROM r")
def group_metrics(spark, sf):
    return M.rank_metrics(points(spark, sf), "s", "y", ["gid"]).select("gid", *_r("auc", "ap", "base_rate"), "n_pos", "n_neg")


@query("q_macro_group_auc", f"WITH {CURVE_SQL}, {_rank_sql('curve', 'gid')} SELECT round(avg(auc), 9) AS macro, round(stddev_pop(auc), 9) AS sd_pop, round(stddev_samp(auc), 9) AS sd_samp, round(median(auc), 9) AS median, count(auc) AS defined, count(*) - count(auc) AS skipped FROM r")
def macro_group_auc(spark, sf):
    return M.macro(M.rank_metrics(curve(spark, sf), "s", "y", ["gid"])).select(*_r("macro", "sd_pop", "sd_samp", "median"), "defined", "skipped")


@query("q_pooled_by_group_max", f"WITH {CURVE_SQL}, d AS (SELECT max(s) AS s, (sum(y) >= 15)::INT AS y FROM curve GROUP BY gid), {_rank_sql('d', '')} SELECT round(auc, 9) AS auc, round(ap, 9) AS ap, n_pos, n_neg FROM r")
def pooled_by_group_max(spark, sf):
    """Series scored by their maximum."""
    g = curve(spark, sf).groupBy("gid").agg(F.max("s").alias("s"), (F.sum("y") >= 15).cast("int").alias("y"))
    return M.rank_metrics(g, "s", "y").select(*_r("auc", "ap"), "n_pos", "n_neg")


_CONF = """SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
    CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END AS f1_neg, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c"""


@query("q_confusion_f1", f"WITH {_LABELLED}, c AS (SELECT lang, count(*) FILTER (s > 1000 AND y = 1) AS tp, count(*) FILTER (s > 1000 AND y = 0) AS fp, count(*) FILTER (s <= 1000 AND y = 1) AS fn, count(*) FILTER (s <= 1000 AND y = 0) AS tn FROM d GROUP BY lang), m AS ({_CONF}) SELECT lang, tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(f1_neg, 9) AS f1_neg, round((f1 + f1_neg) / 2, 9) AS macro_f1, round(accuracy, 9) AS accuracy FROM m")
def confusion_f1(spark, sf):
    c = M.confusion(_labelled(spark, sf), F.col("s") > 1000, F.col("y") == 1, ["lang"])
    return c.select("lang", "tp", "fp", "fn", "tn", *_r("precision", "recall", "f1", "f1_neg", "macro_f1", "accuracy"))


@query("q_best_f1_threshold", f"WITH {_LABELLED}, c AS (SELECT s, sum(y) AS pos, count(*) AS n FROM d GROUP BY s), k AS (SELECT s, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS c, sum(pos) OVER () AS p FROM c), f AS (SELECT s, 2 * tp / (p + c) AS f1 FROM k) SELECT s AS threshold, round(f1, 9) AS f1 FROM f ORDER BY round(f1, 12) DESC, s LIMIT 1")
def best_f1_threshold(spark, sf):
    return M.best_f1(_labelled(spark, sf), "s", "y").select("threshold", *_r("f1"))


@query("q_calibration", f"WITH {CURVE_SQL}, p AS (SELECT least(greatest({SHARE_SQL}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p, y FROM curve), b AS (SELECT floor(p * 10) AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum((p - y) * (p - y)) AS b, sum(-(y * ln(p) + (1 - y) * ln(1 - p))) AS l FROM p GROUP BY 1) SELECT round(sum(b) / sum(n), 9) AS brier, round(sum(l) / sum(n), 9) AS nll, round(sum(abs(sp - sy)) / sum(n), 9) AS ece FROM b")
def calibration(spark, sf):
    return M.calibration(shares(curve(spark, sf)), F.col("p"), F.col("y")).select(*_r("brier", "nll", "ece"))


@query("q_summary", f"WITH {CURVE_SQL} SELECT event_type, min(s) AS least, round(quantile_cont(s, 0.1), 6) AS p10, round(quantile_cont(s, 0.25), 6) AS p25, round(median(s), 6) AS median, round(quantile_cont(s, 0.75), 6) AS p75, round(quantile_cont(s, 0.9), 6) AS p90, max(s) AS most, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd FROM curve GROUP BY event_type")
def summary(spark, sf):
    c = curve(spark, sf).where("not isnan(s)")
    g = c.groupBy("event_type").agg(F.min("s").alias("least"), F.max("s").alias("most"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.stddev_samp("s"), 6).alias("sd"))
    g = g.join(percentiles(c, "s", ["event_type"], [0.1, 0.25, 0.5, 0.75, 0.9]), "event_type", "left")
    return g.select("event_type", "least", *[F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("p10", "p25", "median", "p75", "p90"))], "most", "mean", "sd")


@query(
    "q_trimmed_stats",
    f"""WITH {CURVE_SQL}, q AS (SELECT event_type, quantile_cont(s, 0.05) AS lo, quantile_cont(s, 0.95) AS hi FROM curve GROUP BY event_type)
    SELECT event_type, count(*) AS n, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS sd, round(quantile_cont(s, 0.1), 9) AS p10, round(quantile_cont(s, 0.25), 9) AS p25, round(median(s), 9) AS median, round(quantile_cont(s, 0.75), 9) AS p75, round(quantile_cont(s, 0.9), 9) AS p90, min(s) AS least, max(s) AS most
    FROM curve JOIN q USING (event_type) WHERE s BETWEEN lo AND hi GROUP BY event_type""",
)
def trimmed_stats(spark, sf):
    """Statistics of the values between the 5th and the 95th percentile."""
    c = points(spark, sf)
    q = percentiles(c, "s", ["event_type"], [0.05, 0.95], "ends")
    kept = c.join(q, "event_type").where(F.col("s").between(F.col("ends")[0], F.col("ends")[1]))
    names = ("p10", "p25", "median", "p75", "p90")
    g = kept.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.stddev_pop("s"), 6).alias("sd"), F.min("s").alias("least"), F.max("s").alias("most"))
    g = g.join(percentiles(kept, "s", ["event_type"], [0.1, 0.25, 0.5, 0.75, 0.9]), "event_type", "left")
    return g.select("event_type", "n", "mean", "sd", *[F.round(F.col("q")[k], 9).alias(x) for k, x in enumerate(names)], "least", "most")


@query("q_macro_rows", f"WITH {CURVE_SQL}, m AS (SELECT event_type, gid % 3 AS method, avg(s) AS v FROM curve GROUP BY ALL) SELECT method, event_type, round(v, 6) AS v FROM m UNION ALL SELECT method, 'MACRO', round(avg(v), 6) FROM m GROUP BY method")
def macro_rows(spark, sf):
    """A metric by method and data set, and its macro mean over data sets."""
    m = curve(spark, sf).groupBy((F.col("gid") % 3).alias("method"), "event_type").agg(F.avg("s").alias("v"))
    rows = m.unionByName(m.groupBy("method").agg(F.avg("v").alias("v")).withColumn("event_type", F.lit("MACRO")))
    return rows.select("method", "event_type", F.round("v", 6).alias("v"))


@query("q_frequent_triples", "SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 3")
def frequent_triples(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(F.count("*").alias("n")).where("n >= 3")


@query("q_majority_vote", f"WITH {CURVE_SQL} SELECT gid, CASE WHEN sum(2 * (s > 50)::INT - 1) > 0 THEN 1 WHEN sum(2 * (s > 50)::INT - 1) < 0 THEN 0 ELSE arg_min((s > 50)::INT, idx) END AS vote FROM curve GROUP BY gid")
def majority_vote(spark, sf):
    """Ties go to the first voter."""
    vote = (F.col("s") > 50).cast("int")
    g = curve(spark, sf).groupBy("gid").agg(F.sum(2 * vote - 1).alias("d"), F.min_by(vote, "idx").alias("first"))
    return g.select("gid", F.when(F.col("d") > 0, 1).when(F.col("d") < 0, 0).otherwise(F.col("first")).alias("vote"))


@query("q_weighted_mean", f"WITH {CURVE_SQL} SELECT gid, round(sum(t * CASE WHEN y = 1 THEN NULL ELSE s END) / sum(CASE WHEN y = 1 THEN NULL ELSE t END), 6) AS v FROM curve GROUP BY gid")
def weighted_mean(spark, sf):
    """Null values carry no weight."""
    v = F.when(F.col("y") != 1, F.col("s"))
    return curve(spark, sf).groupBy("gid").agg(F.round(F.sum(F.col("t") * v) / F.sum(F.when(v.isNotNull(), F.col("t"))), 6).alias("v"))


@query("q_correlations", f"WITH {CURVE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY s, event_id) AS a, row_number() OVER (PARTITION BY gid ORDER BY t, event_id) AS b FROM curve) SELECT gid, round(corr(s, y), 6) AS point_biserial, round(corr(a, b), 6) AS spearman, round(regr_slope(s, t), 9) AS slope, round(least(greatest(regr_slope(s, t) * 100, 0), 2), 6) AS clipped FROM r GROUP BY gid HAVING count(*) >= 3 AND stddev_pop(y) > 0")
def correlations(spark, sf):
    a, b = (F.row_number().over(W.partitionBy("gid").orderBy(x, "event_id")) for x in ("s", "t"))
    g = curve(spark, sf).select("*", a.alias("a"), b.alias("b")).groupBy("gid").agg(F.corr("s", "y").alias("point_biserial"), F.corr("a", "b").alias("spearman"), F.regr_slope("s", "t").alias("slope"), F.count("*").alias("n"), F.stddev_pop("y").alias("sd")).where("n >= 3 and sd > 0")
    return g.select("gid", *_r("point_biserial", "spearman", n=6), F.round("slope", 9).alias("slope"), F.round(F.least(F.greatest(F.col("slope") * 100, F.lit(0.0)), F.lit(2.0)), 6).alias("clipped"))


@query("q_residuals", f"WITH {CURVE_SQL}, f AS (SELECT gid, regr_slope(s, t) AS b, regr_intercept(s, t) AS a FROM curve GROUP BY gid) SELECT event_id, round(s - a - b * t, 6) AS residual FROM curve JOIN f USING (gid)")
def residuals(spark, sf):
    c = curve(spark, sf)
    f = c.groupBy("gid").agg(F.regr_slope("s", "t").alias("b"), F.regr_intercept("s", "t").alias("a"))
    return c.join(f, "gid").select("event_id", F.round(F.col("s") - F.col("a") - F.col("b") * F.col("t"), 6).alias("residual"))


@query("q_log_mean_exp", f"WITH {CURVE_SQL}, m AS (SELECT gid, max(s) AS m FROM curve GROUP BY gid) SELECT gid, round(any_value(m) + ln(avg(exp(s - m))), 6) AS v FROM curve JOIN m USING (gid) GROUP BY gid")
def log_mean_exp(spark, sf):
    c = curve(spark, sf)
    return c.join(c.groupBy("gid").agg(F.max("s").alias("m")), "gid").groupBy("gid").agg(F.round(F.max("m") + F.log(F.avg(F.exp(F.col("s") - F.col("m")))), 6).alias("v"))


@query("q_topk_mean", f"WITH {CURVE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY s DESC, idx) AS r, count(*) OVER (PARTITION BY gid) AS n FROM curve) SELECT gid, round(avg(s), 6) AS v FROM r WHERE r <= n // 16 + 1 GROUP BY gid")
def topk_mean(spark, sf):
    """Mean of the largest n // 16 + 1 scores of a series."""
    r = F.row_number().over(W.partitionBy("gid").orderBy(F.desc("s"), "idx"))
    k = F.floor(F.count("*").over(W.partitionBy("gid")) / 16) + 1
    return curve(spark, sf).select("gid", "s", r.alias("r"), k.alias("k")).where("r <= k").groupBy("gid").agg(F.round(F.avg("s"), 6).alias("v"))


@query("q_bimodality", f"WITH {CURVE_SQL}, m AS (SELECT gid, count(*) AS n, avg(s) AS m FROM curve GROUP BY gid), c AS (SELECT gid, any_value(n) AS n, avg(pow(s - m, 2)) AS v, avg(pow(s - m, 3)) AS k3, avg(pow(s - m, 4)) AS k4 FROM curve JOIN m USING (gid) GROUP BY gid) SELECT gid, round((pow(k3 / pow(v, 1.5), 2) + 1) / (k4 / (v * v) - 3 + 3 * pow(n - 1, 2) / ((n - 2) * (n - 3))), 6) AS bc FROM c WHERE n > 3 AND v > 0")
def bimodality(spark, sf):
    g = curve(spark, sf).groupBy("gid").agg(F.skewness("s").alias("g"), F.kurtosis("s").alias("k"), F.count("*").alias("n"), F.var_pop("s").alias("v")).where("n > 3 and v > 0")
    n = F.col("n")
    return g.select("gid", F.round((F.col("g") ** 2 + 1) / (F.col("k") + 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))), 6).alias("bc"))


@query("q_variance_components", f"WITH {CURVE_SQL}, g AS (SELECT gid, count(*) AS n, avg(s) AS m, var_pop(s) * count(*) AS ss FROM curve GROUP BY gid), a AS (SELECT sum(n * m) / sum(n) AS mean, sum(n) AS nn, count(*) AS k, sum(ss) AS within, sum(n * n) AS n2 FROM g), b AS (SELECT sum(n * pow(m - mean, 2)) AS between FROM g, a), v AS (SELECT between / (k - 1) AS msb, within / (nn - k) AS msw, (nn - n2 / nn) / (k - 1) AS n0 FROM a, b) SELECT round((msb - msw) / (msb + (n0 - 1) * msw), 9) AS icc FROM v")
def variance_components(spark, sf):
    """One-way intraclass correlation of the scores inside series."""
    g = curve(spark, sf).groupBy("gid").agg(F.count("*").alias("n"), F.avg("s").alias("m"), (F.var_pop("s") * F.count("*")).alias("ss"))
    a = g.agg(F.sum("n").alias("nn"), F.count("*").alias("k"), F.sum("ss").alias("within"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"))
    v = a.select(((F.col("s2") - F.col("s1") ** 2 / F.col("nn")) / (F.col("k") - 1)).alias("msb"), (F.col("within") / (F.col("nn") - F.col("k"))).alias("msw"), ((F.col("nn") - F.col("n2") / F.col("nn")) / (F.col("k") - 1)).alias("n0"))
    return v.select(F.round((F.col("msb") - F.col("msw")) / (F.col("msb") + (F.col("n0") - 1) * F.col("msw")), 9).alias("icc"))


@query("q_median_fallback", f"WITH {CURVE_SQL}, m AS (SELECT gid, median(s) FILTER (event_type <> 'error') AS m FROM curve GROUP BY gid) SELECT event_id, round(CASE WHEN event_type = 'error' THEN m ELSE s END, 6) AS v FROM curve JOIN m USING (gid)")
def median_fallback(spark, sf):
    """Failed rows take the median of the good ones of their series."""
    c = curve(spark, sf)
    good = F.when(F.col("event_type") != "error", F.col("s"))
    m = c.groupBy("gid").agg(F.median(good).alias("m"))
    return c.join(m, "gid").select("event_id", F.round(F.coalesce(good, "m"), 6).alias("v"))


@query("q_weighted_median", f"WITH {CURVE_SQL}, w AS (SELECT gid, s, event_id, sum(t) OVER (PARTITION BY gid ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS c, sum(t) OVER (PARTITION BY gid) AS total FROM curve) SELECT gid, min(s) AS v FROM w WHERE c >= total / 2 GROUP BY gid")
def weighted_median(spark, sf):
    """Lower weighted median."""
    o = W.partitionBy("gid").orderBy("s", "event_id").rowsBetween(W.unboundedPreceding, 0)
    w = curve(spark, sf).select("gid", "s", F.sum("t").over(o).alias("c"), F.sum("t").over(W.partitionBy("gid")).alias("total"))
    return w.where("c >= total / 2").groupBy("gid").agg(F.min("s").alias("v"))


@query("q_mann_whitney", f"WITH {CURVE_SQL}, c AS (SELECT s, sum(y) AS a, count(*) - sum(y) AS b, count(*) AS n FROM curve GROUP BY s), k AS (SELECT *, sum(b) OVER (ORDER BY s) - b AS below FROM c), m AS (SELECT sum(a * (below + b / 2.0)) AS u, sum(a) AS na, sum(b) AS nb, sum(n) AS n, sum(n * n * n - n) AS ties FROM k) SELECT round(u, 3) AS u, round((u - na * nb / 2) / sqrt(na * nb / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM m")
def mann_whitney(spark, sf):
    return T.mann_whitney(curve(spark, sf), "s", "y").select(F.round("u", 3).alias("u"), F.round("z", 6).alias("z"))


@query("q_percentile_of_value", f"WITH {CURVE_SQL}, v AS (SELECT gid, max(s) FILTER (y = 1) AS v FROM curve GROUP BY gid) SELECT gid, round(100 * (count(*) FILTER (s < v) + 0.5 * count(*) FILTER (s = v)) / count(*), 6) AS pct, round(count(*) FILTER (s >= v - 1e-9) / count(*), 6) AS upper_tail FROM curve JOIN v USING (gid) WHERE v IS NOT NULL GROUP BY gid")
def percentile_of_value(spark, sf):
    c = curve(spark, sf)
    v = c.where("y = 1").groupBy("gid").agg(F.max("s").alias("v"))
    n = F.count("*")
    return c.join(v, "gid").groupBy("gid").agg(F.round(100 * (F.count_if(F.col("s") < F.col("v")) + 0.5 * F.count_if(F.col("s") == F.col("v"))) / n, 6).alias("pct"), F.round(F.count_if(F.col("s") >= F.col("v") - 1e-9) / n, 6).alias("upper_tail"))


@query("q_exact_tests")
def exact_tests(spark, sf):
    """Clopper-Pearson interval, two-sided Fisher test and one-sided sign test of the counts of each series."""
    g = curve(spark, sf).groupBy("gid").agg(*[F.count_if(on).alias(n) for n, on in (("a", (F.col("y") == 1) & (F.col("s") > 50)), ("b", (F.col("y") == 1) & (F.col("s") <= 50)), ("c", (F.col("y") == 0) & (F.col("s") > 50)), ("d", (F.col("y") == 0) & (F.col("s") <= 50)))])
    ci = T.clopper_pearson(F.col("a"), F.col("a") + F.col("b"))
    out = g.select("gid", ci.alias("ci"), T.fisher(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("fisher"), T.sign_test(F.col("a"), F.col("b")).alias("sign"))
    return out.select("gid", F.round("ci.low", 6).alias("low"), F.round("ci.high", 6).alias("high"), F.round("fisher", 9).alias("fisher"), F.round("sign", 9).alias("sign"))


@query("q_holm", f"WITH {CURVE_SQL}, p AS (SELECT gid, min(s) / 20 AS p FROM curve GROUP BY gid), r AS (SELECT *, row_number() OVER (ORDER BY p, gid) AS r, count(*) OVER () AS m FROM p), x AS (SELECT *, p <= 0.05 / (m - r + 1) AS pass FROM r) SELECT gid, round(p, 9) AS p, bool_and(pass) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS rejected FROM x")
def holm(spark, sf):
    p = curve(spark, sf).groupBy("gid").agg((F.min("s") / 20).alias("p"))
    return T.holm(p, "p", "gid", 0.05).select("gid", F.round("p", 9).alias("p"), "rejected")


@query("q_replica_consistency", f"WITH {CURVE_SQL}, r AS (SELECT idx, gid % 2 AS half, avg(s) AS m, stddev_pop(s) AS sd FROM curve GROUP BY ALL) SELECT idx, half, round(greatest(least((m - 0.5 * sd) / 100, 1), 0), 6) AS v FROM r")
def replica_consistency(spark, sf):
    """Mean less half a deviation over replicas, clipped to [0, 1]."""
    r = curve(spark, sf).groupBy("idx", (F.col("gid") % 2).alias("half")).agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("sd"))
    return r.select("idx", "half", F.round(F.greatest(F.least((F.col("m") - 0.5 * F.col("sd")) / 100, F.lit(1.0)), F.lit(0.0)), 6).alias("v"))


@query("q_gate_best", f"WITH {CURVE_SQL}, m AS (SELECT event_type, gid % 5 AS method, avg(s) AS v FROM curve GROUP BY ALL), b AS (SELECT event_type, arg_max(method, (round(v, 9), -method)) AS best, max(v) AS v, any_value(v) FILTER (method = 0) AS base, count(*) FILTER (method > 0) AS n FROM m GROUP BY event_type) SELECT event_type, best, round(v - base, 6) AS gain FROM b")
def gate_best(spark, sf):
    """The best method of each cell and its gain over the baseline."""
    m = curve(spark, sf).groupBy("event_type", (F.col("gid") % 5).alias("method")).agg(F.avg("s").alias("v"))
    b = m.groupBy("event_type").agg(F.max_by("method", F.struct(F.round("v", 9), -F.col("method"))).alias("best"), F.max("v").alias("v"), F.max(F.when(F.col("method") == 0, F.col("v"))).alias("base"))
    return b.select("event_type", "best", F.round(F.col("v") - F.col("base"), 6).alias("gain"))


_LIMITS = "round(quantile_cont(v, 0.025), 9) AS low, round(median(v), 9) AS middle, round(quantile_cont(v, 0.975), 9) AS high, count(v) AS replicates"


@query("q_bootstrap_ci", f"WITH {CURVE_SQL}, d AS (SELECT gid, avg(s) FILTER (y = 1) - avg(s) FILTER (y = 0) AS d FROM curve GROUP BY gid), {T.weights_sql('d', 400)}, m AS (SELECT r, sum(d * w) / sum(w) AS v FROM d JOIN weights USING (gid) WHERE d IS NOT NULL GROUP BY r) SELECT {_LIMITS} FROM m")
def bootstrap_ci(spark, sf):
    """Interval of a mean paired difference over series, by Poisson resampling of series."""
    d = curve(spark, sf).groupBy("gid").agg((F.avg(F.when(F.col("y") == 1, F.col("s"))) - F.avg(F.when(F.col("y") == 0, F.col("s")))).alias("d")).where("d is not null")
    return T.bootstrap_mean(d, "d", "gid", 400)


def _replicates_sql(score: str, group: str, out: str, n: int) -> str:
    """(r, auc, ap) of a score whose groups are weighted by ``weights``."""
    return f"""{out}c AS (SELECT r, {score} AS v, sum(w * y) AS p, sum(w * (1 - y)) AS n FROM scored JOIN weights ON weights.gid = {group} GROUP BY ALL),
    {out}b AS (SELECT *, sum(p) OVER (PARTITION BY r) AS tp, sum(n) OVER (PARTITION BY r) AS tn, coalesce(sum(n) OVER (PARTITION BY r ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb, coalesce(sum(p) OVER (PARTITION BY r ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb FROM {out}c),
    {out} AS (SELECT r, sum(p * (nb + n / 2)) / any_value(tp) / any_value(tn) AS auc, sum(p * (tp - pb) / greatest(tp - pb + tn - nb, 1)) / any_value(tp) AS ap FROM {out}b GROUP BY r)"""


@query("q_bootstrap_auc", f"WITH {CURVE_SQL}, scored AS (SELECT * FROM curve), g AS (SELECT DISTINCT gid FROM curve), {T.weights_sql('g', 100)}, {_replicates_sql('s', 'scored.gid', 'a', 100)}, m AS (SELECT auc AS v FROM a) SELECT {_LIMITS} FROM m")
def bootstrap_auc(spark, sf):
    """Interval of the pooled AUC when series are resampled as clusters."""
    return T.bootstrap_auc(curve(spark, sf), "s", "y", "gid", 100)


@query("q_bootstrap_ap", f"WITH {CURVE_SQL}, scored AS (SELECT * FROM curve), g AS (SELECT DISTINCT gid FROM curve), {T.weights_sql('g', 100)}, {_replicates_sql('s', 'scored.gid', 'a', 100)}, m AS (SELECT ap AS v FROM a) SELECT {_LIMITS} FROM m")
def bootstrap_ap(spark, sf):
    """Interval of the pooled average precision when series are resampled as clusters."""
    return T.interval(T.replicate_metrics(curve(spark, sf), "s", "y", "gid", 100), "ap")


@query("q_bootstrap_rows", f"WITH {CURVE_SQL}, scored AS (SELECT * FROM curve), g AS (SELECT event_id AS gid FROM curve), {T.weights_sql('g', 60)}, {_replicates_sql('s', 'scored.event_id', 'a', 60)}, m AS (SELECT auc AS v FROM a) SELECT {_LIMITS} FROM m")
def bootstrap_rows(spark, sf):
    """Interval of the pooled AUC when rows are resampled, positives and negatives each by themselves, as the AUC divides by the totals of both."""
    return T.bootstrap_auc(curve(spark, sf), "s", "y", "event_id", 60)


@query("q_bootstrap_difference", f"WITH {CURVE_SQL}, scored AS (SELECT * FROM curve), g AS (SELECT DISTINCT gid FROM curve), {T.weights_sql('g', 100)}, {_replicates_sql('s', 'scored.gid', 'a', 100)}, {_replicates_sql('t', 'scored.gid', 'b', 100)}, m AS (SELECT a.auc - b.auc AS v FROM a JOIN b USING (r)) SELECT {_LIMITS}, round(avg((v <= 0)::INT), 9) AS not_better FROM m")
def bootstrap_difference(spark, sf):
    """Paired interval of the difference of two scores' AUC over resampled series."""
    return T.bootstrap_difference(curve(spark, sf), "s", "t", "y", "gid", 100)

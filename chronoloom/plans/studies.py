"""Queries on cross-validated scores, paired studies, resampled valleys and the two-level mixture."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from chronoloom.functions import scalars as S
from chronoloom.functions import stats as B
from chronoloom.operators import graphs as G
from chronoloom.operators import leftout as O
from chronoloom.operators import metrics as M
from chronoloom.operators import probes as P
from chronoloom.operators import thresholds as T
from chronoloom.operators import tiedchains as C
from chronoloom.operators import twolevel as L
from chronoloom.plans.catalog import query
from chronoloom.plans.frames import CURVE_SQL, curve, points, read
from chronoloom.plans.metrics import _rank_sql
from chronoloom.storage import stored

FOLDS, RIDGE, REPLICATES, STAY = 5, 1.0, 100, 0.8


@query("q_stratified_probe")
def stratified_probe(spark, sf):
    """Held-out scores of a ridge probe over folds with equal shares of the label."""
    e = P.stratified_folds(read(spark, sf, "embeddings"), "vec_id", F.col("label") == 0, FOLDS)
    return P.fold_scores(e, "vec_id", "embedding", F.col("label") == 0, F.col("fold"), RIDGE).select("vec_id", "fold", F.col("y").cast("int").alias("y"), F.round("score", 6).alias("score"))


@query("q_grouped_folds")
def grouped_folds(spark, sf):
    """Held-out chances of a logistic regression on score and time; a series is in one fold."""
    x = F.array(F.lit(1.0), F.col("s") / 100, F.col("t") / 700)
    c = stored(points(spark, sf).select("event_id", "gid", x.alias("x"), F.col("y").cast("double").alias("y"), F.pmod("gid", F.lit(FOLDS)).cast("int").alias("fold")), "fold-rows")
    beta = P.logistic_folds(c, 3, "fold", FOLDS, RIDGE)
    chosen = F.array(*[F.array(*[F.lit(float(b)) for b in row]) for row in beta])[F.col("fold")]
    return c.select("event_id", "fold", F.round(S.sigmoid(S.dot(F.col("x"), chosen)), 6).alias("p"))


@query("q_standardised_folds")
def standardised_folds(spark, sf):
    """As the grouped folds, with features standardised over the rows that a fit is made from."""
    x = F.array(F.lit(1.0), F.col("s"), F.col("t"), F.col("idx").cast("double"))
    c = stored(curve(spark, sf).select("event_id", "gid", x.alias("x"), F.col("y").cast("double").alias("y"), F.pmod("gid", F.lit(FOLDS)).cast("int").alias("fold")), "fold-rows")  # the passes read the table, not its sort
    beta = P.logistic_folds(c, 4, "fold", FOLDS, RIDGE, steps=25, standardised=True)
    chosen = F.array(*[F.array(*[F.lit(float(b)) for b in row]) for row in beta])[F.col("fold")]
    return c.select("event_id", "fold", F.round(S.sigmoid(S.dot(F.col("x"), chosen)), 6).alias("p"))


@query("q_leave_one_out")
def leave_one_out(spark, sf):
    """Each vector's score by the ridge regression of all others."""
    return P.leave_one_out(read(spark, sf, "embeddings"), "vec_id", "embedding", F.col("label") == 0, RIDGE).select("vec_id", F.round("score", 6).alias("score"))


@query("q_logistic_leave_one_out")
def logistic_leave_one_out(spark, sf):
    """Each vector's log odds by the logistic regression of all others."""
    return O.logistic_leave_one_out(read(spark, sf, "embeddings"), "vec_id", "embedding", F.col("label") == 0, RIDGE).select("vec_id", F.round("score", 5).alias("score"))


@query("q_principal_projection")
def principal_projection(spark, sf):
    """The standardised vectors on their first two principal axes."""
    p = P.projected(read(spark, sf, "embeddings"), "vec_id", "embedding", 64, 2)
    return p.select("vec_id", *[F.round(F.col("p")[k], 5).alias(f"p{k}") for k in range(2)])


@query(
    "q_evaluation",
    f"""WITH {CURVE_SQL}, cohort AS (SELECT * FROM curve WHERE gid IN (SELECT gid FROM curve WHERE event_type = 'signup')) SELECT round(pooled_auc, 9) AS pooled_auc, round(pooled_ap, 9) AS pooled_ap, round(macro_auc, 9) AS macro_auc, round(macro_ap, 9) AS macro_ap, defined, skipped
    FROM (WITH {_rank_sql("curve", "")} SELECT auc AS pooled_auc, ap AS pooled_ap FROM r), (WITH {_rank_sql("cohort", "gid")} SELECT avg(auc) AS macro_auc, avg(ap) AS macro_ap, count(auc) AS defined, count(*) - count(auc) AS skipped FROM r)""",
)
def evaluation(spark, sf):
    """Pooled metrics of all series, and their means over the series of a cohort."""
    c = points(spark, sf)
    e = M.evaluation(c, "s", "y", "gid", c.where("event_type = 'signup'").select("gid"))
    return e.select(*[F.round(k, 9).alias(k) for k in ("pooled_auc", "pooled_ap", "macro_auc", "macro_ap")], "defined", "skipped")


_AUC = "sum((a.{0} > b.{0})::INT + (a.{0} = b.{0})::INT / 2.0) / count(*)"


@query(
    "q_paired_summary",
    f"""WITH {CURVE_SQL}, d AS (SELECT a.gid, {_AUC.format("s")} AS first, {_AUC.format("t")} AS second FROM curve a JOIN curve b ON a.gid = b.gid AND a.y = 1 AND b.y = 0 GROUP BY a.gid),
    u AS (SELECT gid, first - second AS delta, first, n FROM d JOIN (SELECT gid, count(*) AS n FROM curve GROUP BY gid) USING (gid)), k AS (SELECT 'all' AS subset, * FROM u UNION ALL SELECT CASE WHEN n <= 66 THEN 'few' ELSE 'many' END, * FROM u), {B.weights_sql("d", REPLICATES)},
    m AS (SELECT subset, r, sum(delta * w) / nullif(sum(w), 0) AS v FROM k JOIN weights USING (gid) GROUP BY ALL), i AS (SELECT subset, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM m GROUP BY subset)
    SELECT subset, count(*) AS n, round(avg(first), 9) AS mean, round(avg(delta), 9) AS delta, round(sum(delta) / (SELECT count(*) FROM u), 9) AS contribution, any_value(low) AS low, any_value(high) AS high FROM k JOIN i USING (subset) GROUP BY subset""",
)
def paired_summary(spark, sf):
    """AUC of the score against that of time in the same series: means, mean difference with its resampled interval, and what a subset adds to the difference of all."""
    d = M.paired_metric(curve(spark, sf), "s", "t", "y", "gid")
    subsets = {"all": F.lit(True), "few": F.col("n_rows") <= 66, "many": F.col("n_rows") > 66}
    total = d.agg(F.count("*").alias("total"))
    rows = []
    for name, own in subsets.items():
        part = d.where(own)
        means = part.agg(F.count("*").alias("n"), F.round(F.avg("first"), 9).alias("mean"), F.round(F.avg("delta"), 9).alias("delta"), F.sum("delta").alias("sum"))
        limits = B.interval(B.replicate_means(part, "delta", "gid", REPLICATES), "mean").select("low", "high")
        rows.append(means.crossJoin(limits).crossJoin(total).select(F.lit(name).alias("subset"), "n", "mean", "delta", F.round(F.col("sum") / F.col("total"), 9).alias("contribution"), "low", "high").where("n > 0"))  # one row each
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("q_valley_bootstrap")
def valley_bootstrap(spark, sf):
    """Where the density valley of the log scores lies when events are resampled."""
    c = curve(spark, sf).select(F.log1p("s").alias("x"), "event_id")
    i = T.valley_interval(T.valley_replicates(c, "x", "event_id", REPLICATES), REPLICATES)
    return i.select(*[F.round(k, 6).alias(k) for k in i.columns])


@query("q_high_posterior")
def high_posterior(spark, sf):
    """Chance of the higher of two Gaussian components, the best of four starts, for each event."""
    c = curve(spark, sf).select("event_id", F.log1p("s").alias("x"))
    return c.select("event_id", F.round(T.high_posterior(F.col("x"), T.best_mixture(c, "x")), 5).alias("p"))


@query("q_two_level")
def two_level(spark, sf):
    """Chance that a series is positive, by the two-level mixture fitted to all series."""
    own = F.struct("t", "event_id", F.log1p("s").alias("x"))  # in the order of the positions
    c = points(spark, sf).groupBy("gid").agg(F.array_sort(F.collect_list(own)).alias("l"), F.avg("y").alias("level"))
    series = stored(c.select("gid", F.col("l.x").alias("y"), "level"), "two-level-series")
    fitted = L.fit(series, STAY, 8)
    return L.positives(series, fitted, STAY).select("gid", F.round("w", 4).alias("w"), F.lit(round(fitted.get("log_likelihood", 0.0), 3)).alias("log_likelihood"))


@query("q_tied_chains")
def tied_chains(spark, sf):
    """Chance that a series is positive, by the mixture with a chain for each of its kinds of reading and learned transitions."""
    kinds = list(_KINDS)
    held = [F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type") == k, F.struct("idx", F.log1p("s").alias("x"))))), lambda r: r["x"]).alias(k) for k in kinds]
    series = curve(spark, sf).groupBy("gid").agg(*held)
    p, likelihoods = C.fit(series, kinds, 6)
    return C.positives(series, kinds, p).select("gid", F.round("w", 5).alias("w"), F.lit(round(likelihoods[-1], 3)).alias("log_likelihood"))


_KINDS = ("click", "error", "purchase", "signup", "view")
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(_KINDS)) + " END"


@query(
    "q_reached_windows",
    f"""WITH RECURSIVE {CURVE_SQL}, n AS (SELECT DISTINCT gid, floor(t / 24)::BIGINT AS w, {_KIND_SQL} AS k, gid * 1000000 + floor(t / 24)::BIGINT * 10 + {_KIND_SQL} AS node FROM curve),
    s AS (SELECT a.node AS a, b.node AS b FROM n a JOIN n b ON a.gid = b.gid AND a.k = b.k AND b.w = a.w + 1 WHERE a.k IN (1, 3)), both_ways AS (SELECT a, b FROM s UNION SELECT b, a FROM s),
    r(node, root) AS (SELECT a, a FROM both_ways UNION SELECT x.b, r.root FROM r JOIN both_ways x ON r.node = x.a), named AS (SELECT n.*, coalesce(c.root, n.node) AS root FROM n LEFT JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) c USING (node)),
    u AS (SELECT a.root AS a, b.root AS b FROM named a JOIN named b ON a.gid = b.gid AND a.w = b.w WHERE a.k = 4 AND b.k < 4 AND a.root <> b.root UNION SELECT a.root, b.root FROM named a JOIN named b ON a.gid = b.gid AND b.w = a.w + 5 WHERE a.k = 0 AND b.k = 2 AND a.root <> b.root),
    e AS (SELECT a, b FROM u UNION SELECT b, a FROM u), h0 AS (SELECT DISTINCT gid, w, root FROM named), h1 AS (SELECT DISTINCT gid, w, b AS root FROM h0 JOIN e ON root = a), h2 AS (SELECT DISTINCT gid, w, b AS root FROM h1 JOIN e ON root = a),
    h AS (SELECT gid, w, root, min(hop) AS hop FROM (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL),
    f AS (SELECT h.gid, h.w AS "window", o.w AS found, min(hop) AS hop FROM h JOIN h0 o ON o.gid = h.gid AND o.root = h.root AND o.w <> h.w GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY gid, "window", found < "window" ORDER BY abs(found - "window")) AS k FROM f)
    SELECT gid, "window", found, hop FROM q WHERE k <= 2""",
)
def reached_windows(spark, sf):
    """The two nearest days on either side that a day's kinds of events reach in two hops; errors and signups of days in a row are one node."""
    kind = sum((F.when(F.col("event_type") == k, i).otherwise(0) for i, k in enumerate(_KINDS)), F.lit(0))
    n = curve(spark, sf).select("gid", F.floor(F.col("t") / 24).alias("window"), kind.alias("kind")).distinct().withColumn("node", F.col("gid") * 1_000_000 + F.col("window") * 10 + F.col("kind"))
    a, b = (n.select("gid", *[F.col(c).alias(f"{c}_{side}") for c in ("window", "kind", "node")]) for side in "ab")

    def tied(x, step):
        """Pairs of a group whose windows are a fixed step apart: an equality on both."""
        return x.withColumn("at", F.col("window_a") + step).join(b.withColumnRenamed("window_b", "at"), ["gid", "at"])

    same = tied(a.where("kind_a in (1, 3)"), 1).where("kind_a = kind_b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    within = tied(a.where("kind_a = 4"), 0).where("kind_b < 4").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    across = tied(a.where("kind_a = 0"), 5).where("kind_b = 2").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return G.reached_windows(n, within.unionByName(across), same)

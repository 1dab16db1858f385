"""Queries on probes, propagation, coalitions, judges and further mixtures."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.functions import scalars as S
from chronoloom.operators import graphs as G
from chronoloom.operators import mixtures as X
from chronoloom.operators import probes as P
from chronoloom.operators import ranks as R
from chronoloom.operators import thresholds as T
from chronoloom.plans.catalog import query
from chronoloom.plans.frames import CURVE_SQL, cells_sql, curve, points, n_cells, read, shares
from chronoloom.storage import stored


def _values(spark, rows, ddl="name string, value double"):
    return spark.createDataFrame(rows, ddl)


@query("q_shapley", f"WITH {CURVE_SQL}, v AS (SELECT gid, ln(1 + coalesce(sum(s) FILTER (event_type = 'view'), 0)) AS a, ln(1 + coalesce(sum(s) FILTER (event_type = 'click'), 0)) AS b, ln(1 + coalesce(sum(s) FILTER (event_type = 'signup'), 0)) AS c FROM curve GROUP BY gid), w AS (SELECT *, greatest(a, b) AS ab, greatest(a, c) AS ac, greatest(b, c) AS bc, greatest(a, b, c) AS abc FROM v) SELECT gid, round(a / 3 + (ab - b) / 6 + (ac - c) / 6 + (abc - bc) / 3, 6) AS shapley, round(abc - ab - ac - bc + a + b + c, 6) AS interaction FROM w")
def shapley(spark, sf):
    """Share of the first of three players in the worth of coalitions (their largest member), and the three-way term by inclusion and exclusion."""
    total = lambda k: F.log(1 + F.coalesce(F.sum(F.when(F.col("event_type") == k, F.col("s"))), F.lit(0.0)))
    v = curve(spark, sf).groupBy("gid").agg(total("view").alias("a"), total("click").alias("b"), total("signup").alias("c"))
    worth = lambda *p: F.col(p[0]) if len(p) == 1 else F.greatest(*p)
    share = F.lit(0.0)
    for n in range(3):
        for others in itertools.combinations("bc", n):
            gain = worth("a", *others) - (worth(*others) if others else 0.0)
            share += gain * math.factorial(n) * math.factorial(2 - n) / 6
    mobius = sum((-1) ** (3 - n) * worth(*p) for n in (1, 2, 3) for p in itertools.combinations("abc", n))
    return v.select("gid", F.round(share, 6).alias("shapley"), F.round(mobius, 6).alias("interaction"))


_JUDGES = list(itertools.permutations(("click", "signup", "view")))
_DECIDED = " UNION ALL ".join(f"SELECT {k} AS k, '{'>'.join(o)}' AS judges, count(*) FILTER ((CASE WHEN abs(coalesce({o[0]}, 50) - 50) > 10 THEN {o[0]} > 50 WHEN abs(coalesce({o[1]}, 50) - 50) > 10 THEN {o[1]} > 50 ELSE coalesce({o[2]}, 50) > 50 END)::INT = gold) AS hits FROM v" for k, o in enumerate(_JUDGES))


@query("q_judge_order", f"WITH {CURVE_SQL}, v AS (SELECT gid, avg(s) FILTER (event_type = 'click') AS click, avg(s) FILTER (event_type = 'signup') AS signup, avg(s) FILTER (event_type = 'view') AS view, (sum(y) >= 14)::INT AS gold FROM curve GROUP BY gid), d AS ({_DECIDED}) SELECT judges, hits FROM d ORDER BY hits DESC, k LIMIT 1")
def judge_order(spark, sf):
    """The order of three judges, asked until one is sure, that decides most series rightly; ties go to the first in the alphabet."""
    names = ("click", "signup", "view")
    v = curve(spark, sf).groupBy("gid").agg(*[F.avg(F.when(F.col("event_type") == k, F.col("s"))).alias(k) for k in names], (F.sum("y") >= 14).cast("int").alias("gold"))
    orders = _JUDGES
    sure = lambda k: F.abs(F.coalesce(F.col(k), F.lit(50.0)) - 50) > 10
    decide = lambda o: F.when(sure(o[0]), F.col(o[0]) > 50).when(sure(o[1]), F.col(o[1]) > 50).otherwise(F.coalesce(F.col(o[2]), F.lit(50.0)) > 50)
    hits = v.agg(*[F.count_if(decide(o).cast("int") == F.col("gold")).alias(str(k)) for k, o in enumerate(orders)]).first()
    best = max(range(len(orders)), key=lambda k: (hits[str(k)], -k))
    return spark.createDataFrame([(">".join(orders[best]), hits[str(best)])], "judges string, hits bigint")


@query("q_ridge_probe")
def ridge_probe(spark, sf):
    """AUC of a ridge probe for one label, cross-validated over five folds by a hash of the id; folds are solved from their summed moments."""
    return P.ridge_cv(read(spark, sf, "embeddings"), "vec_id", "embedding", F.col("label") == 0, folds=5, ridge=1.0)


@query("q_logistic_fit")
def logistic_fit(spark, sf):
    """L2 logistic regression of the label on score and time, by Newton steps over summed gradients."""
    x = F.array(F.lit(1.0), F.col("s") / 100, F.col("t") / 700)
    beta = P.logistic(points(spark, sf).select(x.alias("x"), F.col("y").cast("double").alias("y")), 3, ridge=1.0)
    return _values(spark, [(f"b{k}", round(float(b), 6)) for k, b in enumerate(beta)])


@query("q_principal_axes")
def principal_axes(spark, sf):
    """Share of variance of the first principal axes of the standardised vectors, from summed moments."""
    shares, _ = P.principal(read(spark, sf, "embeddings"), "embedding", 64, 5)
    return _values(spark, [(f"axis{k}", round(float(v), 6)) for k, v in enumerate(shares)])


@query("q_mixtures")
def mixtures(spark, sf):
    """Two-component mixtures of Student t, Laplace and beta kind by EM over aggregated values."""
    c = shares(curve(spark, sf))
    rows = []
    for name, kind, v in (("student_t", X.student_t, F.log1p("s")), ("laplace", X.laplace, F.log1p("s")), ("beta", X.beta, F.least(F.greatest(F.col("p"), F.lit(1e-4)), F.lit(1 - 1e-4)))):
        rows += [(name, k, round(float(x), 5)) for k, x in X.fit(c.select(v.alias("x")), "x", kind, steps=12).items()]
    return spark.createDataFrame(rows, "kind string, name string, value double")


@query("q_missing_feature_mixture")
def missing_feature_mixture(spark, sf):
    """Two components with shared variance over two features, of which either may be missing."""
    g = curve(spark, sf).groupBy("gid").agg(F.avg(F.when(F.col("event_type") == "view", F.log1p("s"))).alias("a"), F.avg(F.when(F.col("event_type") == "click", F.log1p("s"))).alias("b"))
    return _values(spark, [(k, round(float(v), 5)) for k, v in X.missing_features(g, ["a", "b"], 20).items()])


def _neighbours(spark, sf, k=8):
    """Undirected nearest-neighbour edges of all items, each asked against all items."""
    e = read(spark, sf, "embeddings")
    found = stored(G.nearest_of_all(e, k).select(F.col("qid").alias("a"), F.col("vec_id").alias("b"), F.col("cosine").alias("w")), "neighbours")
    return stored(found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.max("w").alias("w")), "neighbours"), e


def _knn_sql(k: int) -> str:
    """e: undirected nearest-neighbour edges (a, b, w)."""
    return f"""x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id AS a, o.vec_id AS b, round(list_dot_product(q.e, o.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(o.e, o.e)), 9) AS w FROM x q, x o WHERE q.vec_id <> o.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS r FROM p), t AS MATERIALIZED (SELECT a, b, w FROM r WHERE r <= {k}), e AS MATERIALIZED (SELECT a, b, max(w) AS w FROM (SELECT a, b, w FROM t UNION ALL SELECT b, a, w FROM t) GROUP BY a, b)"""


def _rounds_sql(n: int, step: str) -> str:
    """v0 to vn, each from the one before, which ``step`` names as {before}."""
    return ", ".join(f"v{k} AS MATERIALIZED ({step.format(before=f'v{k - 1}')})" for k in range(1, n + 1))


_SPREAD = _rounds_sql(12, "SELECT seeds.node, 0.8 * coalesce(m, 0) + 0.2 * y AS v FROM seeds LEFT JOIN (SELECT a, sum(s * v) AS m FROM g JOIN {before} f ON g.b = f.node GROUP BY a) u ON u.a = seeds.node")
_HARMONIC = _rounds_sql(30, "SELECT seeds.node, coalesce(anchor, m, 0.5) AS v FROM seeds LEFT JOIN (SELECT a, sum(w * v) / sum(w) AS m FROM e JOIN {before} f ON e.b = f.node GROUP BY a) u ON u.a = seeds.node")
_MAJORITY = _rounds_sql(5, "SELECT f.node, CASE WHEN d > 0 THEN 1 WHEN d < 0 THEN 0 ELSE f.v END AS v FROM {before} f LEFT JOIN (SELECT a, sum(2 * v - 1) AS d FROM e JOIN {before} h ON e.b = h.node GROUP BY a) u ON u.a = f.node")


@query("q_label_spread", f"WITH {_knn_sql(8)}, d AS (SELECT a, sum(w) AS d FROM e GROUP BY a), g AS MATERIALIZED (SELECT e.a, e.b, w / sqrt(d.d * o.d) AS s FROM e JOIN d ON d.a = e.a JOIN d o ON o.a = e.b), seeds AS (SELECT vec_id AS node, (CASE WHEN vec_id % 10 = 0 THEN CASE WHEN label = 0 THEN 1 ELSE -1 END ELSE 0 END)::DOUBLE AS y FROM embeddings), v0 AS (SELECT node, y AS v FROM seeds), {_SPREAD} SELECT node, round(v, 5) AS v FROM v12")
def label_spread(spark, sf):
    """Labels of every tenth item spread over the neighbour graph: f = 0.8 S f + 0.2 y, twelve rounds."""
    edges, e = _neighbours(spark, sf)
    seeds = e.select(F.col("vec_id").alias("node"), F.when(F.col("vec_id") % 10 == 0, F.when(F.col("label") == 0, 1.0).otherwise(-1.0)).otherwise(0.0).alias("y"))
    return P.spread(edges, seeds, 12, 0.8).select("node", F.round("v", 5).alias("v"))


@query("q_harmonic_labels", f"WITH {_knn_sql(8)}, seeds AS (SELECT vec_id AS node, CASE WHEN vec_id % 10 = 0 THEN (label = 0)::INT::DOUBLE END AS anchor FROM embeddings), v0 AS (SELECT node, coalesce(anchor, 0.5) AS v FROM seeds), {_HARMONIC} SELECT node, round(v, 5) AS v FROM v30")
def harmonic_labels(spark, sf):
    """Anchored items keep their value, the others take their neighbours' weighted mean, thirty rounds."""
    edges, e = _neighbours(spark, sf)
    anchor = F.when(F.col("vec_id") % 10 == 0, (F.col("label") == 0).cast("double"))
    return P.harmonic(edges, e.select(F.col("vec_id").alias("node"), anchor.alias("anchor")), 30).select("node", F.round("v", 5).alias("v"))


@query("q_majority_propagation", f"WITH {_knn_sql(5)}, v0 AS (SELECT vec_id AS node, (label < 5)::INT AS v FROM embeddings), {_MAJORITY} SELECT node, v FROM v5")
def majority_propagation(spark, sf):
    """A binary value flips to that of most neighbours, five rounds; ties keep it."""
    edges, e = _neighbours(spark, sf, 5)
    now = e.select(F.col("vec_id").alias("node"), (F.col("label") < 5).cast("int").alias("v"))
    for _ in range(5):
        votes = edges.join(now, edges["b"] == now["node"]).groupBy("a").agg(F.sum(2 * F.col("v") - 1).alias("d"))
        now = stored(now.join(votes, now["node"] == votes["a"], "left").select("node", F.when(F.col("d") > 0, 1).when(F.col("d") < 0, 0).otherwise(F.col("v")).alias("v")), "votes")
    return now


@query("q_density_peaks", f"WITH {_knn_sql(12)}, d AS (SELECT a, sum(exp(-pow((1 - w) / 0.5, 2))) AS rho FROM e GROUP BY a), n AS (SELECT e.a, min(1 - w) AS delta FROM e JOIN d ON d.a = e.a JOIN d o ON o.a = e.b WHERE o.rho > d.rho OR (o.rho = d.rho AND e.b < e.a) GROUP BY e.a) SELECT d.a AS node, round(rho, 5) AS rho, round(coalesce(delta, 2.0), 5) AS delta, round(rho * coalesce(delta, 2.0), 5) AS gamma FROM d LEFT JOIN n USING (a)")
def density_peaks(spark, sf):
    """Items by density times distance to the nearest denser one, from their neighbour lists."""
    edges, e = _neighbours(spark, sf, 12)
    density = edges.groupBy("a").agg(F.sum(F.exp(-((1 - F.col("w")) / 0.5) ** 2)).alias("rho"))
    denser = edges.join(density.select(F.col("a").alias("b"), F.col("rho").alias("rho_b")), "b").join(density, "a").where((F.col("rho_b") > F.col("rho")) | ((F.col("rho_b") == F.col("rho")) & (F.col("b") < F.col("a"))))
    near = denser.groupBy("a").agg(F.min(1 - F.col("w")).alias("delta"))
    return density.join(near, "a", "left").select(F.col("a").alias("node"), F.round("rho", 5).alias("rho"), F.round(F.coalesce("delta", F.lit(2.0)), 5).alias("delta"), F.round(F.col("rho") * F.coalesce("delta", F.lit(2.0)), 5).alias("gamma"))


@query("q_circular_shift_p", f"WITH {CURVE_SQL}, n AS (SELECT gid, count(*) AS n, sum(y) AS k, sum(s) AS total FROM curve GROUP BY gid), i AS (SELECT a.gid, (b.idx - a.idx + n) % n AS shift, sum(b.s) AS inside FROM curve a JOIN curve b USING (gid) JOIN n USING (gid) WHERE a.y = 1 GROUP BY ALL), g AS (SELECT gid, shift, inside / k - (total - inside) / (n - k) AS gap FROM i JOIN n USING (gid) WHERE k < n), o AS (SELECT gid, gap AS own FROM g WHERE shift = 0), p AS (SELECT gid, avg((gap >= own - 1e-9)::INT) AS p FROM g JOIN o USING (gid) GROUP BY gid) SELECT gid, round(p, 9) AS p FROM n LEFT JOIN p USING (gid)")
def circular_shift_p(spark, sf):
    """Exact p of the mean difference inside and outside positives against all circular shifts of the label, by one Fourier product a series."""
    def f(p: pd.DataFrame) -> pd.DataFrame:
        s, y = p["s"].to_numpy(), p["y"].to_numpy(float)
        n, k = len(s), y.sum()
        if not 0 < k < n:
            return pd.DataFrame({"p": [None]}, dtype="float64")
        inside = np.fft.irfft(np.fft.rfft(s) * np.conj(np.fft.rfft(y)), n)
        gap = inside / k - (s.sum() - inside) / (n - k)
        return pd.DataFrame({"p": [float((gap >= gap[0] - 1e-9).mean())]})

    from chronoloom.operators.sequence import per_series

    return per_series(curve(spark, sf).select("gid", "idx", "s", "y"), f, "p double").select("gid", F.round("p", 9).alias("p"))


@query("q_boundary_density", f"WITH {CURVE_SQL}, p AS (SELECT gid, t FROM curve WHERE y = 1), g AS (SELECT (i * 24.0)::DOUBLE AS place, i FROM (SELECT unnest({cells_sql(24.0)}) AS i)), k AS (SELECT gid, i, sum(exp(-0.5 * pow((t - place) / 12, 2))) AS k FROM p JOIN g ON abs(t - place) <= 72 GROUP BY ALL) SELECT gid, i::INT AS i, round(k / sum(k) OVER (PARTITION BY gid), 9) AS density FROM k")
def boundary_density(spark, sf):
    """Kernel density of the times of positives on a grid of days, each reaching three days either way; a point goes to the seven grid places it reaches."""
    near = F.explode(F.sequence(F.greatest(F.ceil((F.col("t") - 72) / 24), F.lit(0)), F.least(F.floor((F.col("t") + 72) / 24), F.lit(n_cells(spark, sf, 24.0) - 1)))).alias("i")
    k = curve(spark, sf).where("y = 1").select("gid", "t", near).groupBy("gid", F.col("i").cast("int").alias("i")).agg(F.sum(F.exp(-0.5 * ((F.col("t") - F.col("i") * 24) / 12) ** 2)).alias("k"))
    return k.select("gid", "i", F.round(F.col("k") / F.sum("k").over(W.partitionBy("gid")), 9).alias("density"))


@query(
    "q_local_secondary_rank",
    f"""WITH {CURVE_SQL}, o AS (SELECT gid, event_id, s, row_number() OVER (PARTITION BY gid ORDER BY s) AS r, rank() OVER (PARTITION BY gid ORDER BY s) - 1 AS below, count(*) OVER (PARTITION BY gid) AS n FROM curve), h AS (SELECT *, least(n, greatest(below - 4, 0) + 9) AS hi FROM o)
    SELECT a.event_id, round((any_value(a.s) - avg(b.s)) / (stddev_pop(b.s) + 1e-12), 6) AS z, (any_value(a.s) - avg(b.s)) / (stddev_pop(b.s) + 1e-12) > 1 AS hit FROM h a JOIN o b ON a.gid = b.gid AND b.r > greatest(a.hi - 9, 0) AND b.r <= a.hi GROUP BY a.event_id""",
)
def local_secondary_rank(spark, sf):
    """How far a score is from the nine scores around it in rank."""
    z = R.local_z(curve(spark, sf).select("gid", "event_id", "s"), "s", ["gid"], 9)
    return z.select("event_id", F.round("z", 6).alias("z"), (F.col("z") > 1).alias("hit"))


@query(
    "q_snap_edges",
    f"""WITH {CURVE_SQL}, q AS (SELECT gid, quantile_cont(s, 0.7) AS q FROM curve GROUP BY gid), e AS (SELECT gid, idx AS edge FROM curve WHERE y = 1),
    c AS (SELECT e.gid, edge, arg_max(c.idx, (c.s, -c.idx)) AS peak, max(c.s) AS s FROM e JOIN curve c ON c.gid = e.gid AND c.idx BETWEEN edge - 2 AND edge + 2 GROUP BY ALL) SELECT gid, edge, CASE WHEN s >= q THEN peak ELSE edge END AS snapped FROM c JOIN q USING (gid)""",
)
def snap_edges(spark, sf):
    """Edges moved to the highest score within two positions if it stands above a quantile."""
    c = curve(spark, sf)
    q = c.groupBy("gid").agg(F.percentile("s", 0.7).alias("q"))
    w = W.partitionBy("gid").orderBy("idx").rowsBetween(-2, 2)
    near = c.select("gid", "idx", "y", F.max(F.struct("s", -F.col("idx"))).over(w).alias("m")).where("y = 1").join(q, "gid")
    return near.select("gid", F.col("idx").alias("edge"), F.when(F.col("m.s") >= F.col("q"), -F.col("m")["col2"]).otherwise(F.col("idx")).alias("snapped"))


@query("q_vector_pooling", "SELECT vec_id, i::INT AS i, round(list_avg(list_slice(embedding::DOUBLE[], i * 8 + 1, i * 8 + 8)), 6) AS v FROM embeddings, range(8) r(i)")
def vector_pooling(spark, sf):
    v = S.fixed_length(F.col("embedding").cast("array<double>"), 8)
    return read(spark, sf, "embeddings").select("vec_id", F.posexplode(v).alias("i", "v")).select("vec_id", "i", F.round("v", 6).alias("v"))


@query("q_box_overlap", "WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice / 1000 AS y, lead(l_quantity) OVER w AS u, lead(l_extendedprice / 1000) OVER w AS v FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice)) SELECT l_orderkey, l_linenumber, round(least(x, u) * least(y, v) / (x * y + u * v - least(x, u) * least(y, v)), 6) AS iou FROM b WHERE u IS NOT NULL")
def box_overlap(spark, sf):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice")
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("l_quantity").alias("x1"), (F.col("l_extendedprice") / 1000).alias("y1"))
    b = read(spark, sf, "lineitem").withColumn("a", box).withColumn("b", F.lead("a").over(w)).where("b is not null")
    return b.select("l_orderkey", "l_linenumber", F.round(S.box_iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query("q_decay_graph", "WITH x AS (SELECT vec_id, vec_id // 50 AS block, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id AS a, o.vec_id AS b, round(list_dot_product(q.e, o.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(o.e, o.e)) * exp(-abs(q.vec_id - o.vec_id) / 25.0::DOUBLE), 6) AS w FROM x q JOIN x o ON q.block = o.block AND q.vec_id <> o.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS r FROM p) SELECT a, b, w FROM r WHERE r <= 3")
def decay_graph(spark, sf):
    """Similar items inside position blocks of 50, weighted by cosine and decay in distance; the three best of each item."""
    e = read(spark, sf, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 50).alias("block"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf["vec_id"].to_numpy(), np.array(pdf["embedding"].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        w = np.round((x @ x.T) * np.exp(-np.abs(ids[:, None] - ids[None, :]) / 25), 6)
        np.fill_diagonal(w, -np.inf)
        order = np.lexsort((np.broadcast_to(ids, w.shape), -w), axis=1)[:, : min(3, len(ids) - 1)]
        return pd.DataFrame({"a": np.repeat(ids, order.shape[1]), "b": ids[order].ravel(), "w": np.take_along_axis(w, order, 1).ravel()})

    return e.groupBy("block").applyInPandas(best, "a bigint, b bigint, w double")


@query("q_kmeans_histogram")
def kmeans_histogram(spark, sf):
    """Two clusters of the scores by Lloyd steps over a histogram, and the share of the upper one in ten bins."""
    h, x = T.histogram(curve(spark, sf).withColumn("s", F.log1p("s")), "s", 400)
    lo, hi = float(x[0]), float(x[-1])
    for _ in range(50):
        up = np.abs(x - hi) < np.abs(x - lo)
        lo, hi = float((h * x)[~up].sum() / max(h[~up].sum(), 1)), float((h * x)[up].sum() / max(h[up].sum(), 1))
    up = np.abs(x - hi) < np.abs(x - lo)
    rows = [(f"bin{k}", round(float(h[k * 40 : k * 40 + 40][up[k * 40 : k * 40 + 40]].sum() / max(h[k * 40 : k * 40 + 40].sum(), 1)), 6)) for k in range(10)]
    return _values(spark, [("low", round(lo, 6)), ("high", round(hi, 6)), *rows])


@query("q_block_permutation", f"WITH {CURVE_SQL}, c AS (SELECT gid, idx, s, idx // 8 AS b, count(*) OVER (PARTITION BY gid) // 8 AS n FROM curve), o AS (SELECT gid, b, row_number() OVER (PARTITION BY gid ORDER BY md5('7:' || gid || ':' || b)) - 1 AS place FROM (SELECT DISTINCT gid, b FROM c WHERE b < n)) SELECT gid, coalesce(place, b) * 8 + idx % 8 AS idx, s FROM c LEFT JOIN o USING (gid, b)")
def block_permutation(spark, sf):
    """Full blocks of eight positions put in the order of a seeded hash; the rest stays at the end."""
    c = curve(spark, sf).select("gid", "idx", "s", F.floor(F.col("idx") / 8).alias("b"))
    n = F.floor(F.count("*").over(W.partitionBy("gid")) / 8)
    blocks = c.withColumn("full", F.col("b") < n)
    order = blocks.where("full").select("gid", "b").distinct().withColumn("to", F.row_number().over(W.partitionBy("gid").orderBy(F.md5(F.concat_ws(":", F.lit("7"), F.col("gid").cast("string"), F.col("b").cast("string"))))) - 1)
    moved = blocks.join(order, ["gid", "b"], "left")
    return moved.select("gid", (F.coalesce("to", "b") * 8 + F.col("idx") % 8).alias("idx"), "s")

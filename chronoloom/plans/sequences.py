"""Queries on recurrences over a series; tested against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.operators import intervals as I
from chronoloom.operators import phases as H
from chronoloom.operators import scans as N
from chronoloom.operators import sequence as Q
from chronoloom.plans.catalog import query
from chronoloom.plans.frames import CURVE_SQL, DURATION_SQL, SPANS_SQL, curve, duration, ranked_curve, shares, spans
from chronoloom.storage import stored


def emission(s: np.ndarray) -> np.ndarray:
    """Log likelihoods of a low and a high state."""
    z = (s - 50) / 20
    return np.column_stack([-0.5 * (z + 0.7) ** 2, -0.5 * (z - 0.7) ** 2])


def _emission(x: np.ndarray) -> np.ndarray:
    return emission(x[:, 0])


def _log_likelihoods(s: float) -> tuple[float, float]:
    """As ``emission``, of one value."""
    z = min(max((s - 50) / 20, -1e150), 1e150)
    return -0.5 * (z + 0.7) ** 2, -0.5 * (z - 0.7) ** 2


STAY = np.array([[0.9, 0.1], [0.2, 0.8]])
START = np.array([2 / 3, 1 / 3])


def _out(p: pd.DataFrame, **columns) -> pd.DataFrame:
    return pd.DataFrame({"idx": p["idx"], **columns})


_EMISSION_SQL = "e AS (SELECT gid, idx, -0.5 * pow((s - 50) / 20 + 0.7, 2) AS e0, -0.5 * pow((s - 50) / 20 - 0.7, 2) AS e1, max(idx) OVER (PARTITION BY gid) AS last FROM curve)"


@query("q_forward_backward", f"""WITH RECURSIVE {CURVE_SQL}, {_EMISSION_SQL}, f AS (SELECT gid, idx, last, 2 / 3.0::DOUBLE AS q0, 1 / 3.0::DOUBLE AS q1, 2 * exp(e0) / (2 * exp(e0) + exp(e1)) AS p FROM e WHERE idx = 0
    UNION ALL SELECT e.gid, e.idx, e.last, 0.9 * p + 0.2 * (1 - p), 0.1 * p + 0.8 * (1 - p), (0.9 * p + 0.2 * (1 - p)) * exp(e0) / ((0.9 * p + 0.2 * (1 - p)) * exp(e0) + (0.1 * p + 0.8 * (1 - p)) * exp(e1)) FROM f JOIN e ON e.gid = f.gid AND e.idx = f.idx + 1),
    b AS (SELECT gid, idx, q0, q1, p AS g FROM f WHERE idx = last UNION ALL SELECT f.gid, f.idx, f.q0, f.q1, f.p * (0.9 * g / b.q0 + 0.1 * (1 - g) / b.q1) FROM b JOIN f ON f.gid = b.gid AND f.idx = b.idx - 1) SELECT gid, idx, round(1 - g, 9) AS p1 FROM b""")
def forward_backward(spark, sf):
    """Chance of the high state, by blocks that are run until they agree: nine digits show the last bits of a chance."""
    p = N.two_states(ranked_curve(spark, sf), "s", N.TwoStates((2.0, 1.0), ((0.9, 0.1), (0.2, 0.8)), _log_likelihoods))
    high = 1 - F.col("p")
    return p.select("gid", "idx", F.when(F.isnan("p"), high).otherwise(F.floor(high * 1e9 + 0.5) / 1e9).alias("p1"))


@query("q_model_averaged_posterior")
def model_averaged_posterior(spark, sf):
    """Posterior averaged over chains whose mean segment lengths run from two steps to the whole series, weighted by their evidence."""

    def chains(n: int) -> tuple[np.ndarray, np.ndarray]:
        lengths = Q.length_grid(n, 2, 5)
        stay = 1 - 1 / np.concatenate([lengths, np.repeat(lengths[-1:], 5 - len(lengths))])  # a short series has one chain, which counts alone whatever its number
        return np.array([[[a, 1 - a], [1 - a, a]] for a in stay]), np.full((5, 2), 0.5)

    p = N.posteriors(ranked_curve(spark, sf), ["s"], N.Chains(_emission, chains))
    return p.select("gid", "idx", F.round(F.get("p", F.lit(1)), 9).alias("p1"))


@query("q_viterbi_path", f"""WITH RECURSIVE {CURVE_SQL}, {_EMISSION_SQL}, f AS (SELECT gid, idx, last, ln(2 / 3.0::DOUBLE) + e0 AS b0, ln(1 / 3.0::DOUBLE) + e1 AS b1, 0 AS c0, 0 AS c1 FROM e WHERE idx = 0
    UNION ALL SELECT e.gid, e.idx, e.last, greatest(b0 + ln(0.9), b1 + ln(0.2)) + e0, greatest(b0 + ln(0.1), b1 + ln(0.8)) + e1, (b1 + ln(0.2) > b0 + ln(0.9))::INT, (b1 + ln(0.8) > b0 + ln(0.1))::INT FROM f JOIN e ON e.gid = f.gid AND e.idx = f.idx + 1),
    b AS (SELECT gid, idx, c0, c1, (b1 > b0)::INT AS state FROM f WHERE idx = last UNION ALL SELECT f.gid, f.idx, f.c0, f.c1, CASE WHEN b.state = 0 THEN b.c0 ELSE b.c1 END FROM b JOIN f ON f.gid = b.gid AND f.idx = b.idx - 1) SELECT gid, idx, state FROM b""")
def viterbi_path(spark, sf):
    """The most likely path, by scans of blocks."""
    return N.best_paths(ranked_curve(spark, sf), ["s"], N.constant(_emission, STAY, START))


@query("q_nested_phases")
def nested_phases(spark, sf):
    """Chances of three nested phases of two sub-states each; purchases are readings of two events."""
    chain = H.phase_chain(H.KINDS["three_nested"], 2, 1.0, (6.0, 4.0), np.array([0.5, 0.3, 0.2]))
    c = ranked_curve(spark, sf).withColumn("pair", (F.col("event_type") == "purchase").cast("int"))
    p = N.posteriors(c, ["s", "pair"], H.readings(chain, [[20.0, 60.0, 120.0]], 40.0))
    share = lambda own: F.round(sum((F.get("p", F.lit(int(k))) for k in np.flatnonzero(own)), F.lit(0.0)), 7)
    return p.select("gid", "idx", share(chain.phase == 1).alias("p_between"), share(chain.positive).alias("p_high"))


@query("q_joint_phases")
def joint_phases(spark, sf):
    """Chance that either of two readings is high, in a chain over both: the score, and the score of clicks and views alone."""
    chain = H.phase_chain(H.KINDS["joint"], 1, 1.0, (8.0, 3.0), np.array([0.7, 0.1, 0.1, 0.1]), keep_before=False)
    c = ranked_curve(spark, sf).withColumn("r", F.when(F.col("event_type").isin("click", "view"), F.col("s")).otherwise(F.lit(float("nan"))))
    p = N.posteriors(c, ["s", "r"], H.readings(chain, [[30.0, 90.0], [20.0, 110.0]], 45.0))
    return p.select("gid", "idx", F.round(1 - F.get("p", F.lit(0)), 7).alias("p_high"))


@query("q_phase_path")
def phase_path(spark, sf):
    """Setup, climax, release: a path that never goes back."""

    def emitted(x: np.ndarray) -> np.ndarray:
        z = (x[:, 0] - 50) / 20
        return np.column_stack([-z * z, z, -np.abs(z - 0.5)])

    return N.best_paths(ranked_curve(spark, sf), ["s"], N.constant(emitted, Q.onward(3), np.ones(3) / 3)).withColumnRenamed("state", "phase")


@query("q_dtw")
def dtw(spark, sf):
    """Alignment cost of the first and second half of a series."""
    def f(p: pd.DataFrame) -> pd.DataFrame:
        s = p["s"].to_numpy()
        a, b = s[: len(s) // 2], s[len(s) // 2 :]
        cost, path = Q.dtw(a, b) if len(a) else (0.0, [])
        return pd.DataFrame({"cost": [round(cost, 6)], "steps": [len(path)]})

    return Q.per_series(curve(spark, sf).select("gid", "idx", "s"), f, "cost double, steps int")


@query("q_isotonic", f"WITH {CURVE_SQL}, c AS (SELECT gid, idx, sum(s) OVER (PARTITION BY gid ORDER BY idx ROWS UNBOUNDED PRECEDING) AS c FROM curve UNION ALL SELECT DISTINCT gid, -1, 0.0 FROM curve), m AS (SELECT a.gid, a.idx + 1 AS a, b.idx AS b, (b.c - a.c) / (b.idx - a.idx) AS m FROM c a JOIN c b ON a.gid = b.gid AND b.idx > a.idx), h AS (SELECT m.gid, v.idx, m.a, max(m.m) AS m FROM m JOIN curve v ON v.gid = m.gid AND v.idx BETWEEN m.a AND m.b GROUP BY ALL) SELECT gid, idx, round(min(m), 9) AS v FROM h GROUP BY gid, idx")
def isotonic(spark, sf):
    f = lambda p: _out(p, v=Q.isotonic_down(p["s"].to_numpy()).round(9))
    return Q.per_series(curve(spark, sf).select("gid", "idx", "s"), f, "idx int, v double")


#: What each of the seven positions of a window takes from its values: the projection on polynomials of degree two.
_HAT = (lambda x: x @ np.linalg.pinv(x))(np.vander(np.arange(-3.0, 4.0), 3, increasing=True)).tolist()
_HAT_SQL = "(VALUES " + ", ".join(f"({o}, {k}, {w!r}::DOUBLE)" for o, row in enumerate(_HAT) for k, w in enumerate(row)) + ") h(o, k, w)"


@query("q_savgol", f"WITH {CURVE_SQL}, n AS (SELECT gid, idx, s, count(*) OVER (PARTITION BY gid) AS n FROM curve), a AS (SELECT *, greatest(least(idx - 3, n - 7), 0) AS a FROM n) SELECT a.gid, a.idx, round(CASE WHEN any_value(n) < 7 THEN any_value(a.s) ELSE sum(w * b.s) END, 6) AS v FROM a JOIN {_HAT_SQL} ON h.o = least(a.idx - a.a, 6) LEFT JOIN curve b ON b.gid = a.gid AND b.idx = a.a + h.k GROUP BY a.gid, a.idx")
def savgol(spark, sf):
    """Local quadratic smoothing over seven positions; the ends are read from the first and the last full window."""
    o = W.partitionBy("gid").orderBy("idx")
    c = curve(spark, sf).select("gid", "idx", "s", F.count("*").over(W.partitionBy("gid")).alias("n"))
    at = F.col("idx") - F.greatest(F.least(F.col("idx") - 3, F.col("n") - 7), F.lit(0))
    c = c.select("*", at.alias("at"), *[F.lag("s", -d).over(o).alias(f"s{d + 6}") for d in range(-6, 7)])
    v = F.col("s")
    for k, row in enumerate(_HAT):
        v = F.when((F.col("n") >= 7) & (F.col("at") == k), sum((w * F.col(f"s{j - k + 6}") for j, w in enumerate(row)), F.lit(0.0))).otherwise(v)
    return c.select("gid", "idx", F.round(v, 6).alias("v"))


@query("q_change_boundaries")
def change_boundaries(spark, sf):
    f = lambda p: pd.DataFrame({"boundary": Q.boundaries(np.abs(np.diff(p["s"].to_numpy(), prepend=p["s"].iloc[0])))})
    return Q.per_series(curve(spark, sf).select("gid", "idx", "s"), f, "boundary int")


@query("q_mdl_segments")
def mdl_segments(spark, sf):
    f = lambda p: pd.DataFrame({"start": Q.segment(p["s"].to_numpy(), 2 * np.log(len(p)) * max(p["s"].var(ddof=0), 1e-9))})
    return Q.per_series(curve(spark, sf).select("gid", "idx", "s"), f, "start int")


@query("q_mean_transport")
def mean_transport(spark, sf):
    f = lambda p: _out(p, v=Q.transport(p["p"].to_numpy(), p["y"].to_numpy(float), 0.5).round(6))
    return Q.per_series(shares(curve(spark, sf)).select("gid", "idx", "p", "y"), f, "idx int, v double")


@query("q_time_residual")
def time_residual(spark, sf):
    """What a label, a type, time and its square leave of the score."""
    c = curve(spark, sf).select("gid", "idx", "s", "y", (F.col("event_type") == "view").cast("int").alias("seen"))
    return Q.residuals(c, "s", ["y", "seen"]).select("gid", "idx", F.round("v", 5).alias("v"))


@query("q_barycentre")
def barycentre(spark, sf):
    f = lambda p: _out(p, v=Q.barycentre(p["s"].to_numpy() + 1e-9, p["s"].to_numpy()[::-1] + p["y"].to_numpy()).round(9))
    return Q.per_series(curve(spark, sf).select("gid", "idx", "s", "y"), f, "idx int, v double")


@query("q_haar_denoise")
def haar_denoise(spark, sf):
    f = lambda p: _out(p, v=Q.haar_denoised(p["s"].to_numpy()).round(6))
    return Q.per_series(curve(spark, sf).select("gid", "idx", "s"), f, "idx int, v double")


@query("q_block_length", f"""WITH {CURVE_SQL}, v AS (SELECT gid, idx, unnest(['s', 'y']) AS c, unnest([s, y]) AS x FROM curve), m AS (SELECT *, x - avg(x) OVER (PARTITION BY gid, c) AS d, count(*) OVER (PARTITION BY gid, c) AS n FROM v),
    q AS (SELECT gid, c, sum(d * d) AS q, any_value(n) AS n FROM m GROUP BY ALL HAVING sum(d * d) > 1e-12), l AS (SELECT a.gid, a.c, b.idx - a.idx AS k, sum(a.d * b.d) AS r FROM m a JOIN m b ON a.gid = b.gid AND a.c = b.c AND b.idx > a.idx GROUP BY ALL),
    f AS (SELECT gid, k FROM l JOIN q USING (gid, c) WHERE n >= 4 GROUP BY gid, k HAVING bool_and(r <= exp(-1) * q)) SELECT c.gid, coalesce(min(k), any_value(c.n))::INT AS block FROM (SELECT gid, count(*) AS n FROM curve GROUP BY gid) c LEFT JOIN f USING (gid) GROUP BY c.gid""")
def block_length(spark, sf):
    """Lag at which score and label have both lost their correlation."""
    f = lambda p: pd.DataFrame({"block": [Q.block_length(p[["s", "y"]].to_numpy(float))]}, dtype="int32")
    return Q.per_series(curve(spark, sf).select("gid", "idx", "s", "y"), f, "block int")


@query("q_sure_threshold")
def sure_threshold(spark, sf):
    def f(p: pd.DataFrame) -> pd.DataFrame:
        s = p["s"].to_numpy()
        d = (s[0 : len(s) // 2 * 2 : 2] - s[1::2]) / np.sqrt(2)
        return pd.DataFrame({"threshold": [round(Q.sure_threshold(d, float(np.median(np.abs(d)) / 0.6745) if len(d) else 0.0), 6)]})

    return Q.per_series(curve(spark, sf).select("gid", "idx", "s"), f, "threshold double")


@query("q_gap_filled_peaks")
def gap_filled_peaks(spark, sf):
    def f(p: pd.DataFrame) -> pd.DataFrame:
        s = p["s"].to_numpy()
        peak = np.flatnonzero((s[1:-1] >= s[:-2]) & (s[1:-1] > s[2:])) + 1 if len(s) > 2 else np.zeros(0, int)
        return pd.DataFrame({"boundary": Q.gap_filled(peak, len(s), 4, 9)})

    return Q.per_series(curve(spark, sf).select("gid", "idx", "s"), f, "boundary int")


@query("q_pairwise_scores")
def pairwise_scores(spark, sf):
    """Scores of event types from their differences at consecutive positions of a series."""
    def f(p: pd.DataFrame) -> pd.DataFrame:
        kinds = sorted(p["event_type"].unique())
        at = p["event_type"].map({k: i for i, k in enumerate(kinds)}).to_numpy()
        edges = np.column_stack([at[1:], at[:-1]])
        ok = edges[:, 0] != edges[:, 1]
        return pd.DataFrame({"event_type": kinds, "v": Q.laplacian_scores(len(kinds), edges[ok], np.diff(p["s"].to_numpy())[ok]).round(6)})

    return Q.per_series(curve(spark, sf).select("gid", "idx", "s", "event_type"), f, "event_type string, v double")


@query("q_greedy_interval_f1")
def greedy_interval_f1(spark, sf):
    """Predicted runs matched one-to-one to gold spans; counts are summed, then precision, recall and F1."""
    c = stored(curve(spark, sf), "curve")
    runs = I.runs(c, F.col("s") >= 60)
    at = c.select("gid", "idx", "t")
    first = runs.join(at.select("gid", F.col("idx").alias("first"), F.col("t").alias("start")), ["gid", "first"])
    predicted = first.join(at.select("gid", F.col("idx").alias("last"), F.col("t").alias("end")), ["gid", "last"]).select("gid", F.lit(0).alias("side"), "start", (F.col("end") + 1).alias("end"))
    gold = spans(spark, sf).select("gid", F.lit(1).alias("side"), "start", "end")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [list(map(tuple, pdf[pdf["side"] == k].sort_values(["start", "end"])[["start", "end"]].to_numpy())) for k in (0, 1)]
        return pd.DataFrame({"gid": [pdf["gid"].iloc[0]], "hit": [Q.greedy_match(*sides, 0.1)], "n_pred": [len(sides[0])], "n_gold": [len(sides[1])]})

    m = predicted.unionByName(gold).groupBy("gid").applyInPandas(match, "gid bigint, hit long, n_pred long, n_gold long").agg(*[F.sum(x).alias(x) for x in ("hit", "n_pred", "n_gold")])
    return m.select("hit", "n_pred", "n_gold", F.round(F.col("hit") / F.col("n_pred"), 9).alias("precision"), F.round(F.col("hit") / F.col("n_gold"), 9).alias("recall"), F.round(2 * F.col("hit") / (F.col("n_pred") + F.col("n_gold")), 9).alias("f1"))


@query("q_nearest_score_pairs")
def nearest_score_pairs(spark, sf):
    """Positives paired with negatives of nearest score, greedily inside a series."""
    def f(p: pd.DataFrame) -> pd.DataFrame:
        a, b = p[p["y"] == 1], p[p["y"] == 0]
        pairs = Q.nearest_pairs(a["s"].to_numpy(), b["s"].to_numpy())
        return pd.DataFrame({"a": [int(a["idx"].iloc[i]) for i, _ in pairs], "b": [int(b["idx"].iloc[j]) for _, j in pairs]}, dtype="int32")

    return Q.per_series(curve(spark, sf).select("gid", "idx", "s", "y"), f, "a int, b int")


@query(
    "q_scored_spans_normal",
    f"""WITH {SPANS_SQL}, c AS (SELECT gid, ord, start, least("end", {DURATION_SQL}) AS "end", v FROM spans WHERE least("end", {DURATION_SQL}) > start),
    m0 AS (SELECT *, max("end") OVER (PARTITION BY gid ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c), m1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY gid ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM m0)
    SELECT gid, round(min(start), 6) AS start, round(max("end"), 6) AS "end", max(v) AS v FROM m1 GROUP BY gid, k""",
)
def scored_spans_normal(spark, sf):
    """Spans clipped to the last event, those of no length left out, then united across gaps of two hours with their largest score."""
    c = spans(spark, sf).withColumn("end", F.least("end", F.lit(duration(spark, sf)))).where("end > start")
    return I.merged(c, 2.0).select("gid", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "v")



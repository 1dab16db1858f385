"""Linear probes from summed moments, and label propagation on edge tables.

Moments of a vector column are summed inside tasks in numpy and added up; what
reaches the driver is one matrix of the vector's length per fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.metrics import rank_metrics
from chronoloom.operators.ranks import global_rank
from chronoloom.storage import stored


def moments(df: DataFrame, fold: str, vector: str, y: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By fold: sum of outer products of (1, x), and of (1, x) times y."""

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for part in parts:
            for f, own in part.groupby(fold):
                x = np.column_stack([np.ones(len(own)), np.array(own[vector].tolist(), dtype=float)])
                now = held.setdefault(int(f), [0.0, 0.0])
                now[0] = now[0] + x.T @ x
                now[1] = now[1] + x.T @ own[y].to_numpy(float)
        yield pd.DataFrame([(f, a.ravel().tolist(), b.tolist()) for f, (a, b) in held.items()], columns=["fold", "xx", "xy"])

    rows = df.select(F.col(fold).cast("int").alias(fold), vector, y).mapInPandas(add, "fold int, xx array<double>, xy array<double>")
    summed = rows.select("fold", F.posexplode(F.concat("xx", "xy")).alias("k", "v")).groupBy("fold", "k").agg(F.sum("v").alias("v"))
    out: dict[int, dict[int, float]] = {}
    for r in summed.toLocalIterator():  # folds times the square of the vector's length
        out.setdefault(r["fold"], {})[r["k"]] = r["v"]
    found = {}
    for f, values in out.items():
        flat = np.array([values[k] for k in range(len(values))])
        n = int((-1 + np.sqrt(1 + 4 * len(flat))) / 2)
        found[f] = flat[: n * n].reshape(n, n), flat[n * n :]
    return found


def ridge_cv(df: DataFrame, key: str, vector: str, positive: Column, folds: int, ridge: float) -> DataFrame:
    """AUC of held-out scores; each row is scored by the solution of the other folds."""
    own = df.select(key, vector, positive.cast("double").alias("y"), F.pmod(F.xxhash64(key), F.lit(folds)).cast("int").alias("fold"))
    m = moments(own, "fold", vector, "y")
    if not m:
        return df.sparkSession.createDataFrame([(None,)], "auc double")
    xx, xy = sum(a for a, _ in m.values()), sum(b for _, b in m.values())
    penalty = ridge * np.eye(len(xy))
    penalty[0, 0] = 1e-9
    beta = {f: np.linalg.solve(xx - m[f][0] + penalty, xy - m[f][1]) for f in m}

    @F.pandas_udf("double")
    def score(v: pd.Series, f: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=float).reshape(len(v), -1)
        b = np.array([beta[int(k)] for k in f]).reshape(len(v), -1)
        return pd.Series(b[:, 0] + (x * b[:, 1:]).sum(axis=1) if len(v) else [], dtype=float)

    return rank_metrics(own.select(F.round(score(vector, "fold"), 9).alias("s"), F.col("y").cast("int").alias("y")), "s", "y").select(F.round("auc", 6).alias("auc"))


def stratified_folds(df: DataFrame, key: str, positive: Column, folds: int) -> DataFrame:
    """``df`` with ``fold``: rows of each class are dealt out in turn, in the order of a hash of the key, so folds have equal shares of both. Rows of no class are left out."""
    hashed = df.withColumn("_h", F.xxhash64(key))
    dealt = [global_rank(hashed.where(own), ["_h", key], "_rank") for own in (positive, ~positive)]
    return dealt[0].unionByName(dealt[1]).withColumn("fold", (F.col("_rank") % folds).cast("int")).drop("_h", "_rank")


def _standardised(xx: np.ndarray, xy: np.ndarray, ridge: float) -> np.ndarray:
    """Intercept and weights of a ridge regression on the standardised features, for the raw ones; from the moments of the rows."""
    n = xx[0, 0]
    mean, target = xx[0, 1:] / n, xy[0] / n
    cov = xx[1:, 1:] - n * np.outer(mean, mean)
    variance = np.diag(cov) / n
    sd = np.where(variance > 1e-18, np.sqrt(np.maximum(variance, 1e-18)), 1.0)
    w = np.linalg.solve(cov / np.outer(sd, sd) + ridge * np.eye(len(sd)), (xy[1:] - n * mean * target) / sd) / sd
    return np.r_[target - mean @ w, w]


def _dots(vectors: pd.Series, rows: np.ndarray) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=float).reshape(len(vectors), -1)
    return rows[:, 0] + (x * rows[:, 1:]).sum(axis=1)


def fold_scores(df: DataFrame, key: str, vector: str, y: Column, fold: Column, ridge: float) -> DataFrame:
    """(key, fold, y, score): each row is scored by a ridge regression on the standardised vectors of the other folds. Give rows of one group one fold, and no group is on both sides."""
    own = stored(df.select(key, vector, y.cast("double").alias("y"), fold.cast("int").alias("fold")), "folds")
    m = moments(own, "fold", vector, "y")
    xx, xy = sum(a for a, _ in m.values()), sum(b for _, b in m.values())
    beta = {f: _standardised(xx - m[f][0], xy - m[f][1], ridge) for f in m}

    @F.pandas_udf("double")
    def score(v: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series(_dots(v, np.array([beta[int(k)] for k in f])) if len(v) else [], dtype=float)

    return own.select(key, "fold", "y", score(vector, "fold").alias("score"))


def leave_one_out(df: DataFrame, key: str, vector: str, y: Column, ridge: float) -> DataFrame:
    """(key, y, score): each row's score by the ridge regression of all others.

    Taking a row out changes the solution by its leverage h alone: score = (fit - h y) / (1 - h). So one pass
    for the moments and one for the scores stand for as many fits as there are rows.
    """
    own = df.select(key, vector, y.cast("double").alias("y"))
    m = moments(own.withColumn("fold", F.lit(0)), "fold", vector, "y")
    if not m:
        return own.select(key, "y", F.lit(None).cast("double").alias("score"))
    xx, xy = m[0]
    penalty = ridge * np.eye(len(xy))
    penalty[0, 0] = 1e-9
    inverse = np.linalg.inv(xx + penalty)
    beta = inverse @ xy

    @F.pandas_udf("double")
    def score(v: pd.Series, y: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        x = np.column_stack([np.ones(len(v)), np.array(v.tolist(), dtype=float)])
        h = ((x @ inverse) * x).sum(axis=1)
        return pd.Series((x @ beta - h * y.to_numpy()) / (1 - h))

    return own.select(key, "y", score(vector, "y").alias("score"))


def projected(df: DataFrame, key: str, vector: str, n: int, axes: int) -> DataFrame:
    """(key, p): each standardised vector on the first principal axes; an axis points to where its largest weight (the first of equals) is positive."""
    m = moments(df.select(F.lit(0).alias("fold"), vector, F.lit(0.0).alias("y")), "fold", vector, "y")
    _, found = principal(df, vector, n, axes)
    lead = np.abs(np.round(found, 9)).argmax(axis=1)
    found = found * np.where(found[np.arange(axes), lead] < 0, -1.0, 1.0)[:, None]
    xx = m[0][0] if m else np.eye(n + 1)
    mean = xx[0, 1:] / xx[0, 0]
    sd = np.sqrt(np.maximum(np.diag(xx)[1:] / xx[0, 0] - mean**2, 0))
    scale = np.where(sd > 1e-12, 1 / np.where(sd > 1e-12, sd, 1), 0)
    turn = (found * scale).T

    @F.pandas_udf("array<double>")
    def on_axes(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=float).reshape(len(v), -1)
        return pd.Series(list((x - mean) @ turn) if len(v) else [], dtype=object)

    return df.select(key, on_axes(vector).alias("p"))


def _variances(df: DataFrame, n: int, fold: str, folds: int) -> np.ndarray:
    """Variances (folds, n) of the features over the rows outside each fold, 1 where a feature doesn't vary."""
    each = df.groupBy(fold).agg(F.count("*").alias("n"), *[F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(n)], *[F.var_pop(F.col("x")[k]).alias(f"v{k}") for k in range(n)]).collect()  # a row a fold
    out = np.ones((folds, n))
    for f in range(folds):
        own = [r for r in each if r[fold] != f]
        share = np.array([r["n"] for r in own], dtype=float)
        if not share.sum():
            continue
        share /= share.sum()
        mean = np.array([[r[f"m{k}"] for k in range(n)] for r in own])
        inside = np.array([[r[f"v{k}"] for k in range(n)] for r in own])
        v = share @ inside + share @ (mean - share @ mean) ** 2
        out[f] = np.where(v > 1e-18, v, 1.0)
    return out


def _fold_moments(rows: DataFrame, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients (folds, n) and curvatures (folds, n, n) of the log likelihood of the rows outside each fold: sums inside tasks, entries added up in Spark. rows: (x, y, f)."""
    folds, n = beta.shape

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, h = np.zeros((folds, n)), np.zeros((folds, n, n))
        for part in parts:
            x = np.array(part["x"].tolist(), dtype=float).reshape(len(part), n)
            p = 0.5 * (1 + np.tanh(0.5 * (x @ beta.T)))
            out = part["f"].to_numpy()[:, None] != np.arange(folds)
            g += ((part["y"].to_numpy(float)[:, None] - p) * out).T @ x
            for f, w in enumerate((p * (1 - p) * out).T):
                h[f] += (x.T * w) @ x
        yield pd.DataFrame({"v": [np.r_[g.ravel(), h.ravel()].tolist()]})

    summed = rows.mapInPandas(add, "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    flat = np.zeros(folds * n * (1 + n))
    for r in summed.toLocalIterator():  # entries of one matrix a fold
        flat[r["k"]] = r["v"]
    return flat[: folds * n].reshape(folds, n), flat[folds * n :].reshape(folds, n, n)


def logistic_folds(df: DataFrame, n: int, fold: str, folds: int, ridge: float, steps: int = 8, standardised: bool = False) -> np.ndarray:
    """Coefficients (folds, n) of y on the array x, each from the rows outside the fold; a Newton step of all folds is one pass.

    With ``standardised`` the fit is that of features brought to mean 0 and deviation 1 over the rows it is made from. As the
    intercept is free, only the penalty changes: a coefficient counts times its feature's deviation.
    """
    beta = np.zeros((folds, n))
    scales = _variances(df, n, fold, folds) if standardised else np.ones((folds, n))
    penalties = ridge * scales * np.r_[0.0, np.ones(n - 1)]
    rows = df.select("x", F.col("y").cast("double").alias("y"), F.col(fold).alias("f"))
    for _ in range(steps):
        slopes, curves = _fold_moments(rows, beta)
        moved = 0.0
        for f, penalty in enumerate(penalties):
            step = np.linalg.solve(curves[f] + np.diag(penalty) + 1e-12 * np.eye(n), slopes[f] - penalty * beta[f])
            beta[f] += step
            moved = max(moved, (np.abs(step) * np.sqrt(scales[f])).max())
        if moved < 1e-9:
            break
    return beta


def logistic(df: DataFrame, n: int, ridge: float, steps: int = 8) -> np.ndarray:
    """Coefficients of y on the array x of n features, the first unpenalised; one aggregation a Newton step."""
    beta = np.zeros(n)
    for _ in range(steps):
        z = sum((F.col("x")[k] * float(b) for k, b in enumerate(beta)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        sums = [F.sum(F.col("x")[k] * (F.col("y") - p)).alias(f"g{k}") for k in range(n)] + [F.sum(F.col("x")[i] * F.col("x")[j] * p * (1 - p)).alias(f"h{i}_{j}") for i in range(n) for j in range(i, n)]
        r = df.agg(*sums).first()
        penalty = ridge * np.r_[0.0, np.ones(n - 1)]
        h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) + np.diag(penalty)
        step = np.linalg.solve(h, np.array([r[f"g{k}"] for k in range(n)]) - penalty * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def principal(df: DataFrame, vector: str, n: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of variance and axes of the standardised vectors; dimensions without variance stay zero."""
    m = moments(df.select(F.lit(0).alias("fold"), vector, F.lit(0.0).alias("y")), "fold", vector, "y")
    if not m:
        return np.zeros(axes), np.zeros((axes, n))
    xx = m[0][0]
    mean = xx[0, 1:] / xx[0, 0]
    cov = xx[1:, 1:] / xx[0, 0] - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.where(sd > 1e-12, 1 / np.where(sd > 1e-12, sd, 1), 0)
    values, vectors = np.linalg.eigh(cov * scale[:, None] * scale[None, :])
    return values[::-1][:axes] / max(values.sum(), 1e-300), vectors[:, ::-1][:, :axes].T


def spread(edges: DataFrame, seeds: DataFrame, rounds: int, alpha: float) -> DataFrame:
    """f = alpha * D^-1/2 W D^-1/2 f + (1 - alpha) y, repeated. seeds: (node, y)."""
    degree = edges.groupBy("a").agg(F.sum("w").alias("d"))
    scaled = stored(edges.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b").select("a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("s")), "scaled-edges")
    now = seeds.select("node", F.col("y").alias("v"))
    for k in range(rounds):
        sent = scaled.join(now, scaled["b"] == now["node"]).groupBy("a").agg(F.sum(F.col("s") * F.col("v")).alias("m"))
        now = seeds.join(sent, seeds["node"] == sent["a"], "left").select("node", (alpha * F.coalesce("m", F.lit(0.0)) + (1 - alpha) * F.col("y")).alias("v"))
        if k % 4 == 3:
            now = stored(now, "node-values")
    return now


def harmonic(edges: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """Anchors (not null) keep their value, others move to the weighted mean of their neighbours."""
    fixed = stored(edges, "edges")
    now = nodes.select("node", F.coalesce("anchor", F.lit(0.5)).alias("v"))
    for k in range(rounds):
        sent = fixed.join(now, fixed["b"] == now["node"]).groupBy("a").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
        now = nodes.join(sent, nodes["node"] == sent["a"], "left").select("node", F.coalesce("anchor", "m", F.lit(0.5)).alias("v"))
        if k % 4 == 3:
            now = stored(now, "node-values")
    return now

"""Scores of each row by a logistic regression of all others, without a fit a row.

The loss is sum(log(1 + exp(-t z))) + ridge / 2 |w|^2 with a free intercept. One Newton step from the fit of all
rows stands for the fit without a row; how far its score can be off follows from how fast the curvature can change
along the step. Rows whose bound is over the tolerance (all of a small table, none of a very long one, as a row's
step shrinks with the number of rows) go on in rounds, with gradients over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.storage import drop, stored

CHUNK, BLOCK, ROUNDS = 8192, 2048, 400


def _chance(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _design(vectors: pd.Series) -> np.ndarray:
    return np.column_stack([np.ones(len(vectors)), np.array(vectors.tolist(), dtype=float).reshape(len(vectors), -1)])


def _moments(own: DataFrame, beta: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature at ``beta``: sums inside tasks, entries added up in Spark."""
    n = len(beta)

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(1 + n + n * n)
        for part in parts:
            x, y = _design(part["x"]), part["y"].to_numpy(float)
            z = x @ beta
            p = _chance(z)
            held += np.r_[np.logaddexp(0, z).sum() - y @ z, x.T @ (p - y), (x.T @ (x * (p * (1 - p))[:, None])).ravel()]
        yield pd.DataFrame({"v": [held.tolist()]})

    summed = own.select("x", "y").mapInPandas(add, "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    flat = np.zeros(1 + n + n * n)
    for r in summed.toLocalIterator():  # entries of one matrix
        flat[r["k"]] = r["v"]
    w = np.r_[0.0, beta[1:]]
    return flat[0] + ridge / 2 * (w @ w), flat[1 : n + 1] + ridge * w, flat[n + 1 :].reshape(n, n) + ridge * np.diag(np.r_[0.0, np.ones(n - 1)])


def logistic_fit(own: DataFrame, n: int, ridge: float, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of y on (1, x), and the curvature there, by Newton steps that are halved until the loss falls."""
    beta = np.zeros(n)
    loss, slope, curve = _moments(own, beta, ridge)
    for _ in range(steps):
        step = -np.linalg.solve(curve, slope)
        if np.abs(step).max() < 1e-11 * (1 + np.abs(beta).max()):
            break
        share = 1.0
        while True:
            found = _moments(own, beta + share * step, ridge)
            if found[0] <= loss + 1e-12 * abs(loss) or share < 1e-6:
                break
            share /= 2
        beta, (loss, slope, curve) = beta + share * step, found
    return beta, curve


def _without(inverse: np.ndarray, x: np.ndarray, weight: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(M - weight x x')^-1 v for each row, where ``inverse`` is that of M."""
    a, b = x @ inverse, v @ inverse
    share = weight * (x * b).sum(axis=1) / (1 - weight * (x * a).sum(axis=1))
    return b + a * share[:, None]


def _length(inverse: np.ndarray, x: np.ndarray, weight: np.ndarray, slope: np.ndarray, step: np.ndarray) -> np.ndarray:
    """How far a step can move the score of the row itself: its length in M - weight x x', times that of x in the inverse."""
    own = (x * _without(inverse, x, weight, x)).sum(axis=1)
    return np.sqrt(np.maximum(-(slope * step).sum(axis=1), 0) * np.maximum(own, 0))


def logistic_leave_one_out(df: DataFrame, key: str, vector: str, y: Column, ridge: float, tolerance: float = 1e-7) -> DataFrame:
    """(key, y, score): each row's log odds by the logistic regression of all others, exact to ``tolerance``.

    Rows without a vector or a class are in no fit and have no score; nor has a row whose others are of one class,
    as the intercept has no bound then. Equal keys are rows of their own. Rows still open after the first step are sent
    to every chunk of CHUNK rows in blocks of BLOCK, so their work is that of all pairs; how many there are falls with the
    number of rows. Rounds take the curvature of the fit of all rows, and a bound of every curvature (a quarter of the
    moments) for rows that this doesn't bring nearer by half.
    """
    spark = df.sparkSession
    rows = stored(df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"), y.cast("double").alias("y")).withColumn("id", F.monotonically_increasing_id()), "left-out-rows")
    whole = F.col("x").isNotNull() & F.col("y").isNotNull()
    own = rows.where(whole)
    seen = own.agg(F.count("*").alias("n"), F.sum("y").alias("positive"), F.max(F.size("x")).alias("size"), F.max(F.aggregate("x", F.lit(1.0), lambda a, v: a + v * v)).alias("norm")).first()
    classes = {1.0: seen["positive"] or 0.0, 0.0: seen["n"] - (seen["positive"] or 0.0)}
    alone = [c for c, count in classes.items() if count < 2]
    none = F.lit(None).cast("double")
    if min(classes.values()) < 1 or len(alone) == 2:
        return rows.select(F.col("key").alias(key), "y", none.alias("score"))
    n, radius = seen["size"] + 1, float(np.sqrt(seen["norm"]))
    beta, curve = logistic_fit(own, n, ridge)
    scored = own.where(~F.col("y").isin(alone)) if alone else own
    inverse = np.linalg.inv(curve)
    state = "id long, x array<double>, y double, beta array<double>, moved double, bounded boolean, open boolean"

    def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x, y = _design(part["x"]), part["y"].to_numpy(float)
            p = _chance(x @ beta)
            slope, weight = -x * (p - y)[:, None], p * (1 - p)
            step = -_without(inverse, x, weight, slope)
            moved = _length(inverse, x, weight, slope, step)
            c = radius * np.linalg.norm(step, axis=1)  # no row's log odds move more
            off = np.where(c < 0.1, 2 * moved * c, np.inf)  # (e^c - 1 - c) / c < 0.6 c, and the curvature at the end is within e^c
            yield pd.DataFrame({"id": part["id"], "x": part["x"], "y": part["y"], "beta": list(beta + step), "moved": moved, "bounded": False, "open": off > tolerance})

    now = stored(scored.select("id", "x", "y").mapInPandas(first, state), "left-out")
    held = [now]
    left = now.where("open").count()
    if left:
        chunks = -(-seen["n"] // CHUNK)
        packed = stored(own.select(F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"), F.struct("x", "y").alias("r")).groupBy("chunk").agg(F.collect_list("r").alias("rows")), "left-out-chunks")
        _, _, quarter = _moments(own, np.zeros(n), ridge)  # chances of a half: no curvature is larger
        least = np.linalg.inv(quarter)
    for _ in range(ROUNDS):
        if not left:
            break
        now = stored(_round(now.where("open"), packed, chunks, -(-left // BLOCK), beta, inverse, least, ridge, tolerance, state), "left-out")
        held.append(now)
        left = now.where("open").count()
    if left:
        raise ValueError(f"{left} rows are not fitted to the tolerance after {ROUNDS} rounds")
    if len(held) > 1:
        drop(packed)
    closed = reduce(lambda a, b: a.unionByName(b), [t.where("not open").select("id", "x", "beta") for t in held])
    score = F.get("beta", F.lit(0)) + F.aggregate(F.zip_with("x", F.slice("beta", 2, n - 1), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return rows.select("id", "key", "y").join(closed.select("id", score.alias("score")), "id", "left").select(F.col("key").alias(key), "y", "score")


def _round(state: DataFrame, packed: DataFrame, chunks: int, blocks: int, beta: np.ndarray, inverse: np.ndarray, least: np.ndarray, ridge: float, tolerance: float, schema: str) -> DataFrame:
    """One step of the open rows: gradients over all chunks, summed, less the row's own."""
    n = len(beta)
    asked = state.select("id", "beta", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    data = packed.select("chunk", "rows", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def slopes(asks: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(data):
            return pd.DataFrame({"id": [], "g": []})
        held = data["rows"].iloc[0]
        x = _design(pd.Series([r["x"] for r in held]))
        p = _chance(x @ np.array(asks["beta"].tolist(), dtype=float).T)
        return pd.DataFrame({"id": asks["id"], "g": list((p - np.array([r["y"] for r in held])[:, None]).T @ x)})

    parts = asked.groupBy("block", "chunk").cogroup(data.groupBy("block", "chunk")).applyInPandas(slopes, "id long, g array<double>")
    summed = parts.groupBy("id").agg(F.array(*[F.sum(F.get("g", F.lit(k))) for k in range(n)]).alias("g"))

    def moved_on(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            x, y = _design(part["x"]), part["y"].to_numpy(float)
            b = np.array(part["beta"].tolist(), dtype=float)
            slope = np.array(part["g"].tolist(), dtype=float) - x * (_chance((x * b).sum(axis=1)) - y)[:, None] + ridge * np.column_stack([np.zeros(len(b)), b[:, 1:]])
            bounded, last = part["bounded"].to_numpy(bool), part["moved"].to_numpy(float)
            p = _chance(x @ beta)

            def stepped(m: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                step = -_without(m, x, weight, slope)
                return step, _length(m, x, weight, slope, step)

            step, moved = stepped(inverse, p * (1 - p))
            sure, sure_moved = stepped(least, np.full(len(x), 0.25))
            turns = ~bounded & (2 * moved > last)
            take = bounded | turns
            step, moved = np.where(take[:, None], sure, step), np.where(take, sure_moved, moved)
            rate = np.where(turns, 1.0, moved / np.maximum(last, 1e-300))
            done = (moved == 0) | (rate < 1) & (moved * rate <= tolerance * (1 - rate))
            yield pd.DataFrame({"id": part["id"], "x": part["x"], "y": part["y"], "beta": list(b + step), "moved": moved, "bounded": take, "open": ~done})

    return state.join(summed, "id").select("id", "x", "y", "beta", "moved", "bounded", "g").mapInPandas(moved_on, schema)

"""A two-level mixture with a chain for each kind of reading, fitted by EM with learned transitions.

A series is negative or positive, and that ties its kinds together. If it is negative,
the readings of a kind have one mean; if positive, they follow a chain of the states
off and on, each with its mean. A kind has its own chain (start and transitions), means
and variance. The E-step gives the chance that a series is positive, the chances of the
states and the expected transitions; the M-step is in closed form, so the likelihood
never falls.

A series is one row of lists, one for each kind, and runs in memory of its length; rows
of a batch run side by side. Each task sends one row of sums, whose size the number of
kinds fixes. Kinds without readings in a series say nothing about it; series without any
reading keep the prior. Null readings are left out of their lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.storage import drop, stored

LEAST = 1e-9
#: Sums of a kind: starting off and on, four transitions, then count, sum and square of negative, off and on readings.
OF_KIND = 15


def padded(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of unlike length as a matrix, and where it holds a reading."""
    own = [np.array([v for v in (x if x is not None else ()) if v is not None], dtype=float) for x in lists]
    out, there = np.zeros((len(own), max(map(len, own), default=0))), np.zeros((len(own), max(map(len, own), default=0)), bool)
    for r, x in enumerate(own):
        out[r, : len(x)], there[r, : len(x)] = x, True
    return out, there


def log_normal(x: np.ndarray, mean: float, variance: float) -> np.ndarray:
    return -0.5 * np.log(2 * np.pi * variance) - (x - mean) ** 2 / (2 * variance)


def run_chain(y: np.ndarray, there: np.ndarray, kind: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many rows at once: log likelihood, chances of the states (rows, steps, 2), expected transitions (rows, 2, 2)."""
    rows, steps = y.shape
    step, start = np.asarray(kind["step"]), np.array([1 - kind["start"], kind["start"]])
    e = np.stack([log_normal(y, kind["off"], kind["variance"]), log_normal(y, kind["on"], kind["variance"])], axis=2)
    top = e.max(axis=2)
    likely = np.where(there[:, :, None], np.exp(e - top[:, :, None]), 1.0)
    evidence = np.where(there, top, 0.0).sum(axis=1)
    ahead, scale = np.zeros((rows, steps, 2)), np.ones((rows, steps))
    for t in range(steps):
        now = (start if t == 0 else ahead[:, t - 1] @ step) * likely[:, t]
        scale[:, t] = np.where(there[:, t], now.sum(axis=1), 1.0)
        ahead[:, t] = np.where(there[:, t, None], now / now.sum(axis=1, keepdims=True), ahead[:, t - 1] if t else start)
    evidence = evidence + np.log(scale).sum(axis=1)
    chances, moved = np.zeros((rows, steps, 2)), np.zeros((rows, 2, 2))
    behind = np.ones((rows, 2))
    for t in range(steps - 1, -1, -1):
        chances[:, t] = np.where(there[:, t, None], ahead[:, t] * behind, 0.0)
        chances[:, t] /= np.maximum(chances[:, t].sum(axis=1, keepdims=True), 1e-300)
        onward = likely[:, t] * behind / scale[:, t, None]
        if t:
            pairs = ahead[:, t - 1, :, None] * step[None] * onward[:, None, :]
            moved += np.where(there[:, t, None, None], pairs, 0.0)
        behind = np.where(there[:, t, None], onward @ step.T, behind)
    return evidence, chances, moved


def expected(lists: dict[str, list], p: dict) -> tuple[np.ndarray, np.ndarray, dict]:
    """Log likelihood and chance of being positive of each row, and what each kind's chain gave."""
    n = len(next(iter(lists.values())))
    negative, positive, of_kind = np.full(n, math.log(1 - p["positive"])), np.full(n, math.log(p["positive"])), {}
    for name, own in lists.items():
        y, there = padded(own)
        kind = p["kinds"][name]
        of_kind[name] = (y, there, *run_chain(y, there, kind))
        positive = positive + of_kind[name][2]
        negative = negative + np.where(there, log_normal(y, kind["negative"], kind["variance"]), 0.0).sum(axis=1)
    total = np.logaddexp(negative, positive)
    return total, np.exp(positive - total), of_kind


def sums(lists: dict[str, list], p: dict) -> np.ndarray:
    """Log likelihood, series and their chance of being positive, then OF_KIND sums a kind."""
    total, w, of_kind = expected(lists, p)
    out = [total.sum(), len(total), w.sum()]
    for y, there, _, chances, moved in of_kind.values():
        first = chances[:, 0] if y.shape[1] else np.zeros((len(w), 2))
        out += [*(w @ first), *(w @ moved.reshape(len(w), 4))]
        weights = [np.where(there, (1 - w)[:, None], 0.0), w[:, None] * chances[:, :, 0], w[:, None] * chances[:, :, 1]]
        out += [float((x * y**k).sum()) for x in weights for k in range(3)]
    return np.array(out)


def updated(s: np.ndarray, kinds: list[str]) -> dict:
    """Parameters from the sums of an E-step."""
    kept = lambda x: min(max(float(x), LEAST), 1 - LEAST)
    p = {"positive": kept(s[2] / max(s[1], 1)), "kinds": {}}
    for k, name in enumerate(kinds):
        own = s[3 + k * OF_KIND : 3 + (k + 1) * OF_KIND]
        moved = own[2:6].reshape(2, 2)
        stays = [kept(moved[i, i] / moved[i].sum()) if moved[i].sum() > LEAST else 0.5 for i in (0, 1)]
        count, total, square = own[6:].reshape(3, 3).T
        mean = total / np.maximum(count, LEAST)
        spread = (square - 2 * mean * total + mean**2 * count).sum() / max(count.sum(), LEAST)
        p["kinds"][name] = {"start": kept(own[1] / max(own[0] + own[1], LEAST)), "step": [[stays[0], 1 - stays[0]], [1 - stays[1], stays[1]]], "negative": float(mean[0]), "off": float(mean[1]), "on": float(mean[2]), "variance": max(float(spread), LEAST)}
    return p


def fit(series: DataFrame, kinds: list[str], steps: int) -> tuple[dict, list[float]]:
    """Parameters after ``steps`` rounds, and the log likelihood before each. series: a column array<double> for each kind. Starts at the quartiles of a kind's readings, chains that stay with 0.8."""
    held = stored(series.select(*kinds), "tied-series")
    p = {"positive": 0.5, "kinds": {}}
    for name in kinds:
        r = held.select(F.explode(name).alias("y")).agg(F.percentile_approx("y", [0.25, 0.75], 100_000).alias("at"), F.var_pop("y").alias("v")).first()
        low, high = r["at"] or (0.0, 0.0)
        p["kinds"][name] = {"start": 0.5, "step": [[0.8, 0.2], [0.2, 0.8]], "negative": low, "off": low, "on": high, "variance": max(r["v"] or 1.0, LEAST)}
    size, likelihoods = 3 + OF_KIND * len(kinds), []
    for _ in range(steps):

        def of_task(parts: Iterator[pd.DataFrame], p: dict = p) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for part in parts:
                for at in range(0, len(part), 500):
                    total += sums({k: part[k].iloc[at : at + 500].tolist() for k in kinds}, p)
            yield pd.DataFrame({"s": [total.tolist()]})

        s = held.mapInPandas(of_task, "s array<double>").agg(*[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(size)]).first()
        s = np.array([x or 0.0 for x in s])
        likelihoods.append(float(s[0]))
        p = updated(s, kinds)
    drop(held)
    return p, likelihoods


def positives(series: DataFrame, kinds: list[str], p: dict) -> DataFrame:
    """``series`` with ``w``, the chance that it is positive."""

    @F.pandas_udf("double")
    def chance(*lists: pd.Series) -> pd.Series:
        return pd.Series(expected(dict(zip(kinds, (x.tolist() for x in lists), strict=True)), p)[1])

    return series.withColumn("w", chance(*kinds))

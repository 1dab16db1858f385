"""A two-level mixture by EM: is a series positive at all, and where.

A series is negative or positive. The readings of a negative one have one mean;
those of a positive one follow a chain of the states off and on with a mean each.
All readings share a variance, and a level of the whole series has a mean for
negative and for positive ones. A series is one row, so an iteration shuffles
nothing: each task sends one row of sums. Rows of a batch run side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.sequence import chain_posteriors
from chronoloom.storage import stored

#: Sums of an E-step: likelihood, series, their chance of being positive, with the level and its square, and of starting
#: on; then count, sum and sum of squares of the readings of negative, off and on.
SUMS = 17
LEAST = 1e-9
#: Readings of the series that run side by side, with what is filled up behind shorter ones.
CELLS = 250_000


def _log_normal(x: np.ndarray, mean: float, variance: float) -> np.ndarray:
    return -0.5 * np.log(2 * np.pi * variance) - (x - mean) ** 2 / (2 * variance)


def _side_by_side(series: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of series that run together: of like length, at most CELLS cells when all are as long as the longest, or one."""
    some: list[int] = []
    for k in sorted(range(len(series)), key=lambda k: len(series[k])):
        if some and (len(some) + 1) * len(series[k]) > CELLS:
            yield some
            some = []
        some.append(k)
    if some:
        yield some


def _expected(series: list[np.ndarray], level: np.ndarray, p: dict[str, float], stay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of series side by side: log likelihoods, chances of being positive, the readings with zeros behind, where there are readings, and the states' chances if it is positive."""
    n = max(1, *map(len, series))
    there = np.arange(n) < np.array([len(y) for y in series])[:, None]
    y = np.zeros(there.shape)
    y[there] = np.concatenate(series)
    step = np.array([[stay, 1 - stay], [1 - stay, stay]])
    emission = np.stack([_log_normal(y, p["off"], p["variance"]), _log_normal(y, p["on"], p["variance"])], axis=2)
    evidence, states = chain_posteriors(np.where(there[:, :, None], emission, 0.0), step[None], np.array([[1 - p["start"], p["start"]]]))  # steps behind a series are as likely in both states
    negative = math.log(1 - p["positive"]) + np.where(there, _log_normal(y, p["negative"], p["variance"]), 0.0).sum(axis=1) + _log_normal(level, p["level0"], p["level_variance"])
    positive = math.log(p["positive"]) + evidence[:, 0] + _log_normal(level, p["level1"], p["level_variance"])
    total = np.logaddexp(negative, positive)
    return total, np.exp(positive - total), y, there, states[:, 0]


def _sums(series: list[np.ndarray], level: np.ndarray, p: dict[str, float], stay: float) -> np.ndarray:
    out = np.zeros(SUMS)
    for some in _side_by_side(series):
        z = level[some]
        total, w, y, there, states = _expected([series[k] for k in some], z, p, stay)
        out[:8] += [total.sum(), len(w), w.sum(), (w * z).sum(), (w * z**2).sum(), ((1 - w) * z).sum(), ((1 - w) * z**2).sum(), (w * states[:, 0, 1]).sum()]
        weights = [np.where(there, x, 0.0) for x in ((1 - w)[:, None], w[:, None] * states[:, :, 0], w[:, None] * states[:, :, 1])]
        out[8:] += [(x * y**k).sum() for x in weights for k in range(3)]
    return out


def fit(series: DataFrame, stay: float, steps: int, tolerance: float = 1e-7) -> dict[str, float]:
    """Parameters after at most ``steps`` iterations, with the log likelihood of the last. series: (y array<double>, level double).

    States stay with the chance ``stay``. Starts at the quartiles of the readings and a deviation to either side of the levels' mean.
    """
    held = stored(series.where("y is not null and level is not null").select("y", F.col("level").cast("double").alias("level")), "two-level")
    levels = held.agg(F.avg("level").alias("m"), F.stddev_pop("level").alias("sd")).first()
    readings = held.select(F.explode("y").alias("y")).agg(F.percentile_approx("y", [0.25, 0.75], 100_000).alias("at"), F.var_pop("y").alias("v")).first()
    if levels["m"] is None or readings["v"] is None:
        return {}
    low, high = readings["at"]
    p = {"positive": 0.5, "start": 0.5, "negative": low, "off": low, "on": high, "variance": max(readings["v"], LEAST), "level0": levels["m"] - levels["sd"], "level1": levels["m"] + levels["sd"], "level_variance": max(levels["sd"] ** 2, LEAST)}
    before = -math.inf
    for _ in range(steps):

        def sums(parts: Iterator[pd.DataFrame], p: dict[str, float] = p) -> Iterator[pd.DataFrame]:
            total = np.zeros(SUMS)
            for part in parts:
                total += _sums([np.asarray(y, float) for y in part["y"]], part["level"].to_numpy(), p, stay)
            yield pd.DataFrame({"s": [total.tolist()]})

        s = held.mapInPandas(sums, "s array<double>").agg(*[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(SUMS)]).first()
        likelihood, n, w, wz, wzz, vz, vzz, on = s[:8]
        if math.isfinite(before) and abs(likelihood - before) <= tolerance * abs(before):
            break
        before = likelihood
        by_state = np.array(s[8:]).reshape(3, 3)
        means = by_state[:, 1] / np.maximum(by_state[:, 0], LEAST)
        spread = (by_state[:, 2] - 2 * means * by_state[:, 1] + means**2 * by_state[:, 0]).sum()
        m1, m0 = wz / max(w, LEAST), vz / max(n - w, LEAST)
        between = wzz - 2 * m1 * wz + m1**2 * w + vzz - 2 * m0 * vz + m0**2 * (n - w)
        kept = lambda x: min(max(x, LEAST), 1 - LEAST)
        p = {"positive": kept(w / n), "start": kept(on / max(w, LEAST)), "negative": means[0], "off": means[1], "on": means[2], "variance": max(spread / max(by_state[:, 0].sum(), LEAST), LEAST), "level0": m0, "level1": m1, "level_variance": max(between / n, LEAST)}
    return p | {"log_likelihood": before}


def positives(series: DataFrame, p: dict[str, float], stay: float) -> DataFrame:
    """``series`` with ``w``, the chance that it is positive; null where y or level is, and without parameters."""
    if not p:
        return series.withColumn("w", F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def chance(y: pd.Series, level: pd.Series) -> pd.Series:
        known = [k for k, (a, b) in enumerate(zip(y, level, strict=True)) if a is not None and b is not None and not math.isnan(b)]
        own, levels, out = [np.asarray(y.iloc[k], float) for k in known], level.iloc[known].to_numpy(dtype=float), np.full(len(y), np.nan)
        for some in _side_by_side(own):
            out[[known[k] for k in some]] = _expected([own[k] for k in some], levels[some], p, stay)[1]
        return pd.Series(out)

    return series.withColumn("w", chance("y", F.col("level").cast("double")))

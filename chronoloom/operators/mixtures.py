"""Two-component mixtures by EM over distinct values; each step is one aggregation."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Parameters = tuple[float, float]
#: log density of a value, and new parameters from weighted sums of (1, x, x^2, |x - centre|) and an own weight.
Kind = tuple[Callable[[Column, Parameters], Column], Callable[[Column, Parameters], Column], Callable[[dict[str, float], Parameters], Parameters]]

FREEDOM = 4.0

student_t: Kind = (
    lambda x, p: F.lit(math.lgamma((FREEDOM + 1) / 2) - math.lgamma(FREEDOM / 2) - 0.5 * math.log(FREEDOM * math.pi * p[1])) - (FREEDOM + 1) / 2 * F.log(1 + (x - p[0]) ** 2 / (FREEDOM * p[1])),
    lambda x, p: (FREEDOM + 1) / (FREEDOM + (x - p[0]) ** 2 / p[1]),  # far values weigh less
    lambda s, p: (s["ux"] / s["u"], max((s["uxx"] - s["ux"] ** 2 / s["u"]) / s["n"], 1e-6)),
)
laplace: Kind = (
    lambda x, p: F.lit(-math.log(2 * p[1])) - F.abs(x - p[0]) / p[1],
    lambda x, p: 1 / F.greatest(F.abs(x - p[0]), F.lit(1e-3)),  # the weighted mean is then the median's fixed point
    lambda s, p: (s["ux"] / s["u"], max(s["dev"] / s["n"], 1e-6)),
)


def _beta_moments(s: dict[str, float], p: Parameters) -> Parameters:
    mean, square = s["x"] / s["n"], s["xx"] / s["n"]
    k = max(mean * (1 - mean) / max(square - mean**2, 1e-9) - 1, 1e-2)
    return max(mean * k, 1e-2), max((1 - mean) * k, 1e-2)


beta: Kind = (
    lambda x, p: F.lit(math.lgamma(p[0] + p[1]) - math.lgamma(p[0]) - math.lgamma(p[1])) + (p[0] - 1) * F.log(x) + (p[1] - 1) * F.log(1 - x),
    lambda x, p: F.lit(1.0),
    _beta_moments,
)


def fit(df: DataFrame, value: str, kind: Kind, steps: int) -> dict[str, float]:
    """Weight and parameters of both components; they begin at the lower and upper half of the values."""
    density, weigh, update = kind
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n")).persist()
    try:
        middle = counts.agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("m"), F.sum("n").alias("n")).first()
        total = middle["n"]

        def sums(r: Column, p: Parameters, k: int) -> list[Column]:
            w = F.col("n") * r
            u = w * weigh(F.col("x"), p)
            return [F.sum(c).alias(f"{name}{k}") for name, c in (("n", w), ("x", w * F.col("x")), ("xx", w * F.col("x") ** 2), ("u", u), ("ux", u * F.col("x")), ("uxx", u * F.col("x") ** 2), ("dev", w * F.abs(F.col("x") - p[0])))]

        def step(r: Column, ps: list[Parameters]) -> tuple[float, list[Parameters]]:
            s = counts.agg(*sums(1 - r, ps[0], 0), *sums(r, ps[1], 1)).first().asDict()
            own = [{name: s[f"{name}{k}"] for name in ("n", "x", "xx", "u", "ux", "uxx", "dev")} for k in (0, 1)]
            return min(max(own[1]["n"] / total, 1e-6), 1 - 1e-6), [update({k: max(v, 1e-12) if k in "nu" else v for k, v in o.items()}, p) for o, p in zip(own, ps, strict=True)]

        w, ps = step((F.col("x") > middle["m"]).cast("double"), [(middle["m"], 1.0), (middle["m"], 1.0)])
        for _ in range(steps):
            odds = F.lit(math.log(w / (1 - w))) + density(F.col("x"), ps[1]) - density(F.col("x"), ps[0])
            w, ps = step(1 / (1 + F.exp(-odds)), ps)
    finally:
        counts.unpersist()
    return {"weight": w, "a0": ps[0][0], "b0": ps[0][1], "a1": ps[1][0], "b1": ps[1][1]}


def missing_features(df: DataFrame, features: list[str], steps: int) -> dict[str, float]:
    """Two Gaussian components with one variance per feature; a missing feature says nothing about its row."""
    held = df.select(*features).persist()
    try:
        r = held.agg(*[f(c).alias(f"{name}_{c}") for c in features for name, f in (("m", F.avg), ("v", F.var_pop))]).first()
        low = {c: (r[f"m_{c}"] or 0.0) - math.sqrt(r[f"v_{c}"] or 1.0) for c in features}
        high = {c: (r[f"m_{c}"] or 0.0) + math.sqrt(r[f"v_{c}"] or 1.0) for c in features}
        var, w = {c: max(r[f"v_{c}"] or 1.0, 1e-6) for c in features}, 0.5
        for _ in range(steps):
            odds = F.lit(math.log(w / (1 - w)))
            for c in features:
                odds += F.coalesce(((F.col(c) - low[c]) ** 2 - (F.col(c) - high[c]) ** 2) / (2 * var[c]), F.lit(0.0))
            p = 1 / (1 + F.exp(-odds))
            seen = lambda c, x: F.sum(F.when(F.col(c).isNotNull(), x))
            s = held.agg(F.avg(p).alias("w"), *[a for c in features for a in (seen(c, p).alias(f"n1_{c}"), seen(c, 1 - p).alias(f"n0_{c}"), seen(c, p * F.col(c)).alias(f"x1_{c}"), seen(c, (1 - p) * F.col(c)).alias(f"x0_{c}"), seen(c, F.col(c) ** 2).alias(f"q_{c}"))]).first()
            w = min(max(s["w"], 1e-6), 1 - 1e-6)
            for c in features:
                n1, n0 = max(s[f"n1_{c}"] or 0, 1e-9), max(s[f"n0_{c}"] or 0, 1e-9)
                high[c], low[c] = (s[f"x1_{c}"] or 0) / n1, (s[f"x0_{c}"] or 0) / n0
                var[c] = max(((s[f"q_{c}"] or 0) - n1 * high[c] ** 2 - n0 * low[c] ** 2) / (n1 + n0), 1e-6)
    finally:
        held.unpersist()
    return {"weight": w, **{f"low_{c}": low[c] for c in features}, **{f"high_{c}": high[c] for c in features}, **{f"var_{c}": var[c] for c in features}}

"""Statistical tests and resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.operators.metrics import _cumulated
from chronoloom.operators.ranks import global_rank, value_counts
from chronoloom.storage import stored


def mann_whitney(df: DataFrame, score: str, label: str) -> DataFrame:
    """U of the positives and its z with tie correction."""
    c = _cumulated(value_counts(df, score, label, []), [])
    n = F.col("_pos") + F.col("_neg")
    m = c.agg(F.sum(F.col("_pos") * (F.col("neg_below") + F.col("_neg") / 2)).alias("u"), F.max("P").alias("a"), F.max("N").alias("b"), F.sum(n * n * n - n).alias("ties"))
    total = F.col("a") + F.col("b")
    sd = F.sqrt(F.col("a") * F.col("b") / 12 * (total + 1 - F.col("ties") / (total * (total - 1))))
    return m.select("u", ((F.col("u") - F.col("a") * F.col("b") / 2) / sd).alias("z"))


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial."""
    if k <= 0:
        return 1.0
    if p <= 0 or p >= 1:
        return float(p >= 1)
    return min(1.0, sum(math.exp(_log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1)))


def _bisect(f, lo: float = 0.0, hi: float = 1.0) -> float:
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(k: Column, n: Column, alpha: float = 0.05) -> Column:
    """Struct (low, high); null for n = 0. The ends solve binomial tails by bisection."""

    @F.pandas_udf("struct<low:double,high:double>")
    def interval(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ks, ns in batches:
            rows = []
            for a, b in zip(ks.astype(int), ns.astype(int), strict=True):
                low = 0.0 if a == 0 else _bisect(lambda p: _tail(a, b, p) < alpha / 2)  # noqa: B023
                high = 1.0 if a == b else _bisect(lambda p: 1 - _tail(a + 1, b, p) > alpha / 2)  # noqa: B023
                rows.append((low, high) if b else (None, None))
            yield pd.DataFrame(rows, columns=["low", "high"])

    return interval(k, n)


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided: all tables with the same margins that are no more likely."""

    @F.pandas_udf("double")
    def test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        def one(a: int, b: int, c: int, d: int) -> float:
            at = lambda x: _log_choose(a + b, x) + _log_choose(c + d, a + c - x) - _log_choose(a + b + c + d, a + c)
            own = at(a)
            return min(1.0, sum(math.exp(at(x)) for x in range(max(0, a - d), min(a + b, a + c) + 1) if at(x) <= own + 1e-7))

        return pd.Series([one(*map(int, r)) for r in zip(a, b, c, d, strict=True)])

    return test(a, b, c, d)


def sign_test(positive: Column, negative: Column) -> Column:
    """One-sided: chance of at least so many positives if either sign is as likely."""

    @F.pandas_udf("double")
    def test(p: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_tail(int(a), int(a + b), 0.5) for a, b in zip(p, n, strict=True)])

    return test(positive, negative)


def holm(df: DataFrame, p: str, key: str, alpha: float) -> DataFrame:
    """Step-down test: a hypothesis is rejected if it and all with smaller p pass. The first failure's rank decides, so no rows are ordered in one task."""
    ranked = global_rank(df, [p, key])
    n = df.count()
    passed = F.col(p) <= alpha / (F.lit(n) - F.col("rank"))
    first = ranked.where(~passed).agg(F.min("rank").alias("r")).first()["r"]
    return ranked.withColumn("rejected", F.lit(True) if first is None else F.col("rank") < first).drop("rank")


#: Modulus and rounds of the hash behind the weights, and the chances of a Poisson(1) number to be at most 0 to 6.
MODULUS, ROUNDS = 2_147_483_629, 3
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(7)]


def poisson_weights(group: np.ndarray, replicates: int) -> np.ndarray:
    """A Poisson(1) number for each group and replicate that follows from both alone, so that a lost task is repeated alike: (groups, replicates)."""
    x = (group.astype(np.int64)[:, None] % MODULUS * 7919 + np.arange(1, replicates + 1) * 104_729 + 17) % MODULUS
    for _ in range(ROUNDS):
        x = (x * x + 3 * x + 11) % MODULUS
    return np.searchsorted(POISSON, x / MODULUS, side="right")


def weights_sql(groups: str, replicates: int) -> str:
    """The same weights in SQL: (gid, r, w) of the groups' ids ``gid``."""
    x = "(gid % 2147483629 * 7919 + r * 104729 + 17) % 2147483629"
    steps = [f"h0 AS (SELECT gid, r, {x} AS x FROM {groups}, range(1, {replicates + 1}) t(r))"]
    steps += [f"h{k + 1} AS (SELECT gid, r, (x * x + 3 * x + 11) % {MODULUS} AS x FROM h{k})" for k in range(ROUNDS)]
    ends = " + ".join(f"(x / {MODULUS}.0::DOUBLE >= {e!r}::DOUBLE)::INT" for e in POISSON)
    return ", ".join(steps) + f", weights AS (SELECT gid, r, {ends} AS w FROM h{ROUNDS})"


def interval(per_replicate: DataFrame, value: str) -> DataFrame:
    """2.5 %, 50 % and 97.5 % points over the replicates that define the value, and their number."""
    return per_replicate.agg(F.round(F.percentile(value, 0.025), 9).alias("low"), F.round(F.median(value), 9).alias("middle"), F.round(F.percentile(value, 0.975), 9).alias("high"), F.count(value).alias("replicates"))


def replicate_means(df: DataFrame, value: str, group: str, replicates: int) -> DataFrame:
    """(replicate, mean): weighted means of the groups' values. A task sends one row a replicate."""

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((2, replicates))
        for part in parts:
            w = poisson_weights(part[group].to_numpy(), replicates)
            held += np.array([part[value].to_numpy(float) @ w, w.sum(axis=0)])
        yield pd.DataFrame({"replicate": np.arange(1, replicates + 1), "v": held[0], "w": held[1]})

    return df.select(group, value).mapInPandas(sums, "replicate int, v double, w double").groupBy("replicate").agg((F.sum("v") / F.nullif(F.sum("w"), F.lit(0.0))).alias("mean"))


def bootstrap_mean(df: DataFrame, value: str, group: str, replicates: int) -> DataFrame:
    return interval(replicate_means(df, value, group, replicates), "mean")


def replicate_metrics(df: DataFrame, score: str, label: str, group: str, replicates: int, rows_per_part: int = 25_000) -> DataFrame:
    """(replicate, auc, ap) when groups, given by whole numbers, are resampled. Two scores get the same weights, so their differences are paired.

    Counts of each group's distinct scores are cut into ranges of the score. What
    stands in the ranges below is summed per range and replicate; a range then
    takes its running sums for all replicates at once. Nothing is multiplied by
    the number of replicates before it is shuffled.
    """
    counts = stored(value_counts(df, score, label, [group]), "bootstrap-counts")
    parts = max(1, counts.count() // rows_per_part)
    cuts = counts.agg(F.percentile_approx("_s", [k / parts for k in range(1, parts)], 10_000).alias("c")).first()["c"] if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts or []))]), lambda c: c <= F.col("_s"))) if cuts else F.lit(0)
    counts = counts.select(F.col(group).alias("_g"), "_s", "_pos", "_neg", part.alias("_part"))
    numbers = np.arange(1, replicates + 1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, own in b.groupby("_part"):
                w = poisson_weights(own["_g"].to_numpy(), replicates)
                held[k] = held.get(k, 0) + np.array([own["_pos"].to_numpy() @ w, own["_neg"].to_numpy() @ w])
        for k, x in held.items():
            yield pd.DataFrame({"_part": k, "replicate": numbers, "p": x[0], "n": x[1]})

    totals = counts.mapInPandas(sums, "_part int, replicate int, p bigint, n bigint").groupBy("_part", "replicate").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    by, up = W.partitionBy("replicate"), W.partitionBy("replicate").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    below = totals.select("_part", "replicate", *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"{c}0") for c in "pn"], *[F.sum(c).over(by).alias(f"{c}1") for c in "pn"])

    def metrics(own: pd.DataFrame, offsets: pd.DataFrame) -> pd.DataFrame:
        own, offsets = own.sort_values("_s"), offsets.sort_values("replicate")
        w = poisson_weights(own["_g"].to_numpy(), replicates)
        first = np.flatnonzero(np.concatenate([[True], np.diff(own["_s"].to_numpy()) != 0]))
        pos, neg = (np.add.reduceat(own[c].to_numpy()[:, None] * w, first, axis=0) for c in ("_pos", "_neg"))
        p0, n0, p1, n1 = (offsets[c].to_numpy() for c in ("p0", "n0", "p1", "n1"))
        pos_below, neg_below = p0 + np.cumsum(pos, axis=0) - pos, n0 + np.cumsum(neg, axis=0) - neg
        chosen = np.maximum(p1 - pos_below + n1 - neg_below, 1)
        return pd.DataFrame({"replicate": numbers, "won": (pos * (neg_below + neg / 2)).sum(axis=0), "prec": (pos * (p1 - pos_below) / chosen).sum(axis=0), "p": p1, "n": n1})

    found = counts.groupBy("_part").cogroup(below.groupBy("_part")).applyInPandas(metrics, "replicate int, won double, prec double, p bigint, n bigint")
    sums_of = found.groupBy("replicate").agg(F.sum("won").alias("won"), F.sum("prec").alias("prec"), F.max("p").alias("p"), F.max("n").alias("n"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return sums_of.select("replicate", F.when(both, F.col("won") / F.col("p") / F.col("n")).alias("auc"), F.when(both, F.col("prec") / F.col("p")).alias("ap"))


def bootstrap_auc(df: DataFrame, score: str, label: str, group: str, replicates: int) -> DataFrame:
    """Interval of the AUC when groups are resampled as clusters."""
    return interval(replicate_metrics(df, score, label, group, replicates), "auc")


def bootstrap_difference(df: DataFrame, first: str, second: str, label: str, group: str, replicates: int, metric: str = "auc") -> DataFrame:
    """Interval of a metric's difference between two scores over the same resampled groups, and the share of replicates in which the first isn't better."""
    a, b = (replicate_metrics(df, s, label, group, replicates).select("replicate", F.col(metric).alias(name)) for s, name in ((first, "a"), (second, "b")))
    d = a.join(b, "replicate").select((F.col("a") - F.col("b")).alias("d"))
    return interval(d, "d").crossJoin(d.agg(F.round(F.avg((F.col("d") <= 0).cast("int")), 9).alias("not_better")))  # one row each

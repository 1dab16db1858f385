"""Recurrences over long series as scans of blocks: forward-backward and best paths without a task that holds a series.

A step of a chain is a matrix, and steps are chained by an associative product: over
(log-sum-exp, +) for chances, over (max, +) for best paths. A block of ``BLOCK`` steps
is reduced to one matrix. These matrices are rows of the next level, reduced in their
turn until a series has one block; on the way down each block learns the vector that
comes in before it and the one that follows it. The blocks then run through their own
steps. Each level has a 64th of the rows of the one below, so a series of any length is
dealt over many tasks, and a task works on many blocks side by side.

All values are logarithms: nothing underflows, and impossible steps are -inf.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.storage import drop, stored

BLOCK = 64

Reduce = Callable[..., np.ndarray]
SUM: Reduce = np.logaddexp.reduce
BEST: Reduce = np.maximum.reduce


@dataclass(frozen=True)
class Chains:
    """Chains of hidden states: log likelihoods (steps, states) of values (steps, columns), and for a series of n steps the transitions (chains, states, states) and starts (chains, states)."""

    emission: Callable[[np.ndarray], np.ndarray]
    of_length: Callable[[int], tuple[np.ndarray, np.ndarray]]

    def logs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(divide="ignore"):
            return tuple(np.log(np.asarray(x, dtype=float)) for x in self.of_length(n))


def constant(emission: Callable[[np.ndarray], np.ndarray], transition: np.ndarray, start: np.ndarray) -> Chains:
    """One chain for all series."""
    return Chains(emission, lambda n: (np.asarray(transition)[None], np.asarray(start)[None]))


def product(a: np.ndarray, b: np.ndarray, reduce: Reduce) -> np.ndarray:
    """(..., i, l) and (..., l, j) to (..., i, j)."""
    return reduce(a[..., :, :, None] + b[..., None, :, :], axis=-2)


def forth(v: np.ndarray, m: np.ndarray, reduce: Reduce) -> np.ndarray:
    return reduce(v[..., :, None] + m, axis=-2)


def back(m: np.ndarray, v: np.ndarray, reduce: Reduce) -> np.ndarray:
    return reduce(m + v[..., None, :], axis=-1)


def identity(k: int) -> np.ndarray:
    return np.where(np.eye(k, dtype=bool), 0.0, -np.inf)


def padded(lists: pd.Series, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Flat lists of up to BLOCK matrices as (rows, BLOCK, *shape), filled up with the identity, and their numbers."""
    size = int(np.prod(shape))
    held = [np.asarray(x, dtype=float) for x in lists]
    n = np.array([len(x) // size for x in held])
    out = np.broadcast_to(identity(shape[-1]), (len(held), BLOCK, *shape)).copy()
    for r, x in enumerate(held):
        out[r, : n[r]] = x.reshape(n[r], *shape)
    return out, n


def steps(part: pd.DataFrame, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
    """Step matrices (rows, BLOCK, chains, states, states) of blocks (block, n, steps, values), and the blocks' lengths."""
    lengths = part["steps"].to_numpy()
    flat = np.concatenate([np.asarray(v, dtype=float) for v in part["values"]])
    e = np.asarray(chains.emission(flat.reshape(int(lengths.sum()), -1)))
    k = e.shape[1]
    logs = {n: chains.logs(n) for n in set(part["n"])}
    g = len(next(iter(logs.values()))[0])
    out = np.broadcast_to(identity(k), (len(part), BLOCK, g, k, k)).copy()
    ends = np.cumsum(lengths)
    for r, (block, n, end, size) in enumerate(zip(part["block"], part["n"], ends, lengths, strict=True)):
        transition, start = logs[n]
        out[r, :size] = transition[None] + e[end - size : end, None, None, :]
        if block == 0:  # whatever comes in, the series begins here
            out[r, 0] = (start + e[end - size])[:, None, :]
    return out, lengths


def total(m: np.ndarray, reduce: Reduce) -> np.ndarray:
    """Product of the second axis, by halves."""
    while m.shape[1] > 1:
        m = product(m[:, ::2], m[:, 1::2], reduce)
    return m[:, 0]


def _pieces(part: pd.DataFrame, chains: int, states: int) -> Iterator[pd.DataFrame]:
    """Up to 512 rows at a time, fewer if the terms of their products would be over four million."""
    size = min(512, max(1, (1 << 22) // (BLOCK // 2 * chains * states**3)))
    for k in range(0, len(part), size):
        yield part.iloc[k : k + size]


def _vector(g: int, k: int) -> np.ndarray:
    """What comes in before a series: its first step takes no notice of the state."""
    return np.where(np.arange(k) == 0, 0.0, -np.inf)[None].repeat(g, axis=0)


MATRICES, ENDS = "gid bigint, i bigint, m array<double>", "gid bigint, i bigint, before array<double>, after array<double>"


def scan(matrices: DataFrame, longest: int, chains: int, states: int, reduce: Reduce) -> DataFrame:
    """Rows (gid, i, m) to (gid, i, before, after): the vector that comes in before a matrix, and the one that follows it. ``longest``: the most matrices of a series."""
    shape = (chains, states, states)
    bundles = matrices.groupBy("gid", F.floor(F.col("i") / BLOCK).alias("j")).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("l"))
    bundles = bundles.select("gid", "j", F.flatten(F.transform("l", lambda x: x["m"])).alias("ms"))

    def totals(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for p in _pieces(whole, chains, states):
                m, _ = padded(p["ms"], shape)
                yield pd.DataFrame({"gid": p["gid"], "i": p["j"], "m": list(total(m, reduce).reshape(len(p), -1))})

    def ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for p in _pieces(whole, chains, states):
                m, n = padded(p["ms"], shape)
                a = np.stack([np.asarray(x, dtype=float) for x in p["before"]]).reshape(len(p), chains, states)
                z = np.stack([np.asarray(x, dtype=float) for x in p["after"]]).reshape(len(p), chains, states)
                before, after = np.empty((len(p), BLOCK, chains, states)), np.empty((len(p), BLOCK, chains, states))
                for t in range(BLOCK):
                    before[:, t] = a
                    a = forth(a, m[:, t], reduce)
                for t in reversed(range(BLOCK)):
                    after[:, t] = z
                    z = back(m[:, t], z, reduce)
                at = np.arange(BLOCK)[None] < n[:, None]
                row = np.repeat(np.arange(len(p)), n)
                i = (p["j"].to_numpy()[:, None] * BLOCK + np.arange(BLOCK))[at]
                yield pd.DataFrame({"gid": p["gid"].to_numpy()[row], "i": i, "before": list(before[at].reshape(len(i), -1)), "after": list(after[at].reshape(len(i), -1))})

    first = F.array(*[F.lit(float(x)) for x in _vector(chains, states).ravel()])
    if longest <= BLOCK:
        around = bundles.withColumns({"before": first, "after": F.array_repeat(F.lit(0.0), chains * states)})
    else:
        outer = scan(bundles.select("gid", "j", "ms").mapInPandas(totals, MATRICES), -(-longest // BLOCK), chains, states, reduce)
        around = bundles.join(outer.withColumnRenamed("i", "j"), ["gid", "j"])
    return around.select("gid", "j", "ms", "before", "after").mapInPandas(ends, ENDS)


def blocks_of(series: DataFrame, values: list[str]) -> DataFrame:
    """Rows (gid, idx, n, values) to a written table of blocks (gid, block, n, steps, and their values one after the other)."""
    own = F.struct("idx", F.array(*[F.col(v).cast("double") for v in values]).alias("v"))
    held = series.groupBy("gid", F.floor(F.col("idx") / BLOCK).alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(own)).alias("l"))
    return stored(held.select("gid", "block", "n", F.size("l").alias("steps"), F.flatten(F.transform("l", lambda x: x["v"])).alias("values")), "scan-blocks")


def _around(blocks: DataFrame, longest: int, chains: Chains, g: int, k: int, reduce: Reduce) -> DataFrame:
    """Blocks with the vectors before and after them."""

    def totals(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for p in _pieces(whole, g, k):
                yield pd.DataFrame({"gid": p["gid"], "i": p["block"], "m": list(total(steps(p, chains)[0], reduce).reshape(len(p), -1))})

    around = scan(blocks.mapInPandas(totals, MATRICES), -(-longest // BLOCK), g, k, reduce)
    return blocks.join(around.withColumnRenamed("i", "block"), ["gid", "block"])


def _inside(p: pd.DataFrame, chains: Chains, g: int, k: int, reduce: Reduce) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step matrices, lengths and the vectors after each step (rows, BLOCK, chains, states) of blocks with what comes in before them."""
    m, n = steps(p, chains)
    a = np.stack([np.asarray(x, dtype=float) for x in p["before"]]).reshape(len(p), g, k)
    ahead = np.empty((len(p), BLOCK, g, k))
    for t in range(BLOCK):
        ahead[:, t] = a = forth(a, m[:, t], reduce)
    return m, n, ahead


def _shape(chains: Chains, columns: int) -> tuple[int, int]:
    transition, _ = chains.of_length(1)
    return len(transition), np.asarray(chains.emission(np.zeros((1, columns)))).shape[1]


def posteriors(series: DataFrame, values: list[str], chains: Chains) -> DataFrame:
    """Rows (gid, idx, n, values) to (gid, idx, p): chances of the states at each step. Several chains are averaged by their evidence."""
    g, k = _shape(chains, len(values))
    longest = series.agg(F.max("n").alias("n")).first()["n"] or 1
    blocks = blocks_of(series, values)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for p in _pieces(whole, g, k):
                m, n, ahead = _inside(p, chains, g, k, SUM)
                z = np.stack([np.asarray(x, dtype=float) for x in p["after"]]).reshape(len(p), g, k)
                joint = np.empty_like(ahead)
                for t in reversed(range(BLOCK)):
                    joint[:, t] = ahead[:, t] + z
                    z = back(m[:, t], z, SUM)
                joint -= SUM(SUM(joint, axis=3), axis=2)[:, :, None, None]
                chance = np.exp(joint).sum(axis=2)
                yield pd.DataFrame({"gid": p["gid"], "block": p["block"], "p": [chance[r, : n[r]].ravel() for r in range(len(p))]})

    found = _around(blocks, longest, chains, g, k, SUM).mapInPandas(run, "gid bigint, block bigint, p array<double>")
    each = F.transform(F.sequence(F.lit(0), (F.size("p") / k).cast("int") - 1), lambda i: F.slice("p", i * k + 1, F.lit(k)))
    return found.select("gid", "block", F.posexplode(each).alias("at", "p")).select("gid", (F.col("block") * BLOCK + F.col("at")).alias("idx"), "p")


def best_paths(series: DataFrame, values: list[str], chains: Chains) -> DataFrame:
    """Rows (gid, idx, n, values) to (gid, idx, state): the most likely path of one chain, the lower state of equals, from the end.

    A block keeps the path that leads to each of its last states, and which state that path comes from. These
    maps are scanned like matrices, and tell each block the last state of its own.
    """
    _, k = _shape(chains, len(values))
    longest = series.agg(F.max("n").alias("n")).first()["n"] or 1
    blocks = blocks_of(series, values)

    def paths(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for p in _pieces(whole, 1, k):
                m, n, ahead = _inside(p, chains, 1, k, BEST)
                before = np.stack([np.asarray(x, dtype=float) for x in p["before"]]).reshape(len(p), 1, k)
                into = np.concatenate([before[:, None], ahead[:, :-1]], axis=1)[:, :, 0]
                came = (into[:, :, :, None] + m[:, :, 0]).argmax(axis=2)  # rows, steps, states: the state before
                line = np.arange(len(p))
                path = np.empty((len(p), k, BLOCK), dtype=np.int64)
                state = np.broadcast_to(np.arange(k), (len(p), k)).copy()
                for t in reversed(range(BLOCK)):
                    inside = (t < n)[:, None]
                    path[:, :, t] = state
                    state = np.where(inside, came[line[:, None], t, state], state)
                last = (p["block"].to_numpy() + 1) * BLOCK >= p["n"].to_numpy()
                end = np.where(last, ahead[line, n - 1, 0].argmax(axis=1), -1)
                step = np.where((state[:, None, :] == np.arange(k)[None, :, None]) & ((end < 0)[:, None, None] | (np.arange(k) == end[:, None])[:, None, :]), 0.0, -np.inf)
                yield pd.DataFrame({"gid": p["gid"], "block": p["block"], "end": end, "m": list(step.reshape(len(p), -1)), "steps": n, "paths": [path[r, :, : n[r]].ravel() for r in range(len(p))]})

    found = stored(_around(blocks, longest, chains, 1, k, BEST).mapInPandas(paths, "gid bigint, block bigint, end int, m array<double>, steps int, paths array<int>"), "scan-paths")
    after = scan(found.select("gid", F.col("block").alias("i"), "m"), -(-longest // BLOCK), 1, k, BEST)
    follows = after.select("gid", F.col("i").alias("block"), F.array_position("after", 0.0).cast("int").alias("follows"))
    own = found.join(follows, ["gid", "block"]).withColumn("state", F.when(F.col("end") >= 0, F.col("end")).otherwise(F.col("follows") - 1))
    drop(blocks)
    return own.select("gid", "block", F.posexplode(F.slice("paths", F.col("state") * F.col("steps") + 1, F.col("steps"))).alias("at", "state")).select("gid", (F.col("block") * BLOCK + F.col("at")).alias("idx"), "state")


@dataclass(frozen=True)
class TwoStates:
    """Weights of the states at the start, chances of a step from row to column, log likelihoods of both states, of one value."""

    start: tuple[float, float]
    steps: tuple[tuple[float, float], tuple[float, float]]
    logs: Callable[[float], tuple[float, float]]

    def likelihoods(self, lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Of blocks as (rows, BLOCK), filled up with ones, and the blocks' lengths."""
        n = np.array([len(x) for x in lists])
        out = np.ones((2, len(lists), BLOCK))
        at = np.arange(BLOCK)[None] < n[:, None]
        logs = [self.logs(x) for x in np.concatenate([np.asarray(x, dtype=float) for x in lists]).tolist()]
        for k in range(2):  # the C library's exp, which vectors of numpy round otherwise
            out[k][at] = [math.exp(x[k]) for x in logs]
        return out, n

    def after(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances of both states a step later."""
        (a, b), (c, d) = self.steps
        return a * p + c * (1 - p), b * p + d * (1 - p)

    def forth(self, likely: np.ndarray, first: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances after each step of blocks, given those before them, and which blocks have a step without one: there a guess stands. ``first`` blocks begin a series."""
        out, lost = np.empty(likely.shape[1:]), np.zeros(len(p), dtype=bool)
        with np.errstate(all="ignore"):
            for t in range(BLOCK):
                q0, q1 = self.after(p)
                if t == 0:
                    q0, q1 = np.where(first, self.start[0], q0), np.where(first, self.start[1], q1)
                p = q0 * likely[0][:, t] / (q0 * likely[0][:, t] + q1 * likely[1][:, t])
                lost |= np.isnan(p)
                out[:, t] = p = np.where(np.isnan(p), 0.5, p)
        return out, lost

    def back(self, p: np.ndarray, n: np.ndarray, last: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Chances given the whole series, from those of the steps that follow the blocks; ``last`` blocks end a series."""
        out = np.empty_like(p)
        with np.errstate(all="ignore"):
            for t in reversed(range(BLOCK)):
                q0, q1 = self.after(p[:, t])
                step = p[:, t] * (self.steps[0][0] * g / q0 + self.steps[0][1] * (1 - g) / q1)
                step = np.where(last & (t == n - 1), p[:, t], step)
                out[:, t] = g = np.where(t < n, step, g)
        return out


def two_states(series: DataFrame, value: str, chain: TwoStates) -> DataFrame:
    """Rows (gid, idx, n, value) to (gid, idx, p): chances of the first state given the whole series, the very doubles of a loop from row to row.

    Blocks begin with a guess, and each then begins with what the block before it ended in, until no beginning changes:
    that is the loop's result. A chain forgets its beginning within a block or two, so a few rounds do. It never forgets
    a value under which both likelihoods are 0, or NaN: the loop then gives NaN in the whole series, and null if a value
    is null. So a guess stands for such a step, which makes no more rounds, and its series is marked. No step's chance is 0.
    """
    blocks = blocks_of(series, [value]).withColumn("missing", F.exists("values", lambda x: x.isNull())).drop("steps")

    def forward(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            likely, n = chain.likelihoods(p["values"])
            found, lost = chain.forth(likely, p["block"].to_numpy() == 0, p["held"].to_numpy())
            yield p.assign(p=[x[:k] for x, k in zip(found, n, strict=True)], out=found[np.arange(len(p)), n - 1], lost=lost)

    def backward(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n = np.array([len(x) for x in part["p"]])
            p = np.full((len(part), BLOCK), 0.5)
            p[np.arange(BLOCK)[None] < n[:, None]] = np.concatenate(list(part["p"]))
            last = (part["block"].to_numpy() + 1) * BLOCK >= part["n"].to_numpy()
            found = chain.back(p, n, last, part["held"].to_numpy())
            yield part.assign(g=[x[:k] for x, k in zip(found, n, strict=True)], out=found[:, 0], lost=False)

    def settled(given: DataFrame, step: Callable, result: str, towards: int) -> DataFrame:
        """Blocks with a list ``result``, run until what a block begins with is what its neighbour ended in."""
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema) + f", held double, {result} array<double>, out double, lost boolean"
        now = stored(given.withColumn("held", F.lit(0.5)).mapInPandas(step, schema), "two-states")
        while True:
            beside = now.select("gid", (F.col("block") + towards).alias("block"), F.col("out").alias("following"))
            met = now.join(beside, ["gid", "block"], "left")
            if met.where(F.col("following").isNotNull() & ~F.col("held").eqNullSafe(F.col("following"))).isEmpty():
                return now.drop("held", "out")
            following = stored(met.withColumn("held", F.coalesce("following", "held")).select(*given.columns, "held").mapInPandas(step, schema), "two-states")
            drop(now)
            now = following

    ahead = settled(blocks, forward, "p", 1)
    whole = settled(ahead.select("gid", "block", "n", "p"), backward, "g", -1).drop("lost")
    drop(blocks)
    marked = ahead.where("missing or lost").groupBy("gid").agg(F.max("missing").alias("missing"))  # a row for each series that has no chances
    p = F.when(F.col("missing"), F.lit(None)).when(~F.col("missing"), F.lit(float("nan"))).otherwise(F.col("p"))
    each = whole.join(marked, "gid", "left").select("gid", "block", "missing", F.posexplode("g").alias("at", "p"))
    return each.select("gid", (F.col("block") * BLOCK + F.col("at")).alias("idx"), p.alias("p"))

"""Centroid clustering: Lloyd's rounds under Yinyang bounds, exact in whole numbers.

A component x becomes the integer floor(scale * x). Centroids start as the ``k``
vectors whose keys have the smallest hashes. The centroids are clustered into
``k / GROUP_SIZE`` groups once. Each vector keeps an upper bound of the distance
to its own centroid and, for each group, one lower bound of the distances to the
group's other centroids. In a round the bounds move by as much as the centroids
have moved. A vector whose upper bound is below all its lower bounds stays where
it is (global filter, tried once more with the exact distance to its centroid);
of the others, groups whose lower bound is above the best distance so far are
passed over (group filter), and the centroids of those that are left are scanned
exactly. Both filters are strict, so an equally near centroid of a smaller number
is always scanned.

Bounds are doubles, rounded away from the true distance; whatever decides is a
whole number: squared distances come from matrix products that are exact in
doubles while components are below 2 ** 22, and from 64-bit integers otherwise.

The vectors with their bounds are a table in the shared folder, written anew by
each round and read by the next; the one before is deleted. Sums of a cluster are
aggregated by Spark before they shuffle, a row a cluster reaches the driver. Only
centroids, their groups and their movements go to the tasks: numbers that ``k``
and ``dims`` fix, whatever the input.

Rows with a null vector, with another number of components than ``dims``, or with
a null or non-finite component are left out. Rows repeated with their key count
each, and of rows with equal hashes the smaller vector comes first. A row without
a key is clustered, and starts a centroid only if rows with keys are too few.
With fewer rows than ``k`` there are fewer centroids, with none the result is
empty. A centroid whose vectors have all gone stays where it is. A component of
2 ** 27 or more in size stops the query, as squared distances might not fit a
long. Columns other than key and vector aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.shared import drop, stored

CENTROIDS, ROUNDS, DIMS, SCALE, GROUP_SIZE = 40, 5, 64, 256, 10
#: Before a key in the hash that chooses the first centroids.
SALT = "2:"

#: Components below the first have exact products in doubles; none may reach the second.
EXACT, LIMIT = 1 << 22, 1 << 27
#: Relative error that bounds are rounded by, far above that of their sums.
SLACK = 1e-9

BOUNDS = pa.schema([("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.list_(pa.float64()))])


def whole(vector: Column, scale: int) -> Column:
    """Components as integers, floor(scale * x)."""
    floor = lambda x: F.floor(x.cast("double") * scale)
    return F.transform(vector, lambda x: F.when(F.abs(floor(x)) < LIMIT, floor(x).cast("int")).otherwise(F.raise_error(F.lit(f"a component reaches {LIMIT} after scaling"))))


def finite(vector: Column) -> Column:
    """No component is null, not a number or infinite; false or null for a null vector."""
    return F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def matrix(lists: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return np.asarray(lists.flatten()).astype(kind, copy=False).reshape(len(lists), width)


def exact(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers in the fastest type that keeps products exact."""
    most = max((int(np.abs(a).max()) for a in (x, c) if a.size), default=0)
    kind = np.float64 if most < EXACT else np.int64
    return x.astype(kind), c.astype(kind)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def squared_each(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to the same row of c."""
    return ((x - c) ** 2).sum(1)


def up(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 + SLACK)


def down(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 - SLACK)


def grouped(centroids: np.ndarray, size: int = GROUP_SIZE, rounds: int = 5) -> np.ndarray:
    """Group of each centroid: a few of Lloyd's rounds among the centroids themselves."""
    x = centroids.astype(np.float64)
    n = max(1, -(-len(x) // size))
    middle = x[np.linspace(0, len(x) - 1, n).astype(int)]
    own = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        own = squared(x, middle).argmin(1)
        middle = np.stack([x[own == g].mean(0) if (own == g).any() else middle[g] for g in range(n)])
    return np.unique(own, return_inverse=True)[1]  # no group without a centroid


def assigned(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, group: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A round for some vectors: cluster, upper bound, lower bounds, and how many distances were taken. ``own`` is -1 for a vector that has no centroid yet."""
    x, c = exact(x, centroids)
    known, taken = own >= 0, 0
    farthest = np.array([moved[group == g].max() for g in range(lower.shape[1])])
    upper = np.where(known, (upper + moved[own]) * (1 + SLACK), np.inf)
    lower = np.where(known[:, None], (lower - farthest) * (1 - SLACK), 0.0)
    own = own.copy()

    rows = np.flatnonzero(~(upper < lower.min(1)))
    worst = np.inf if x.dtype.kind == "f" else np.iinfo(np.int64).max
    best = np.full(len(rows), worst, x.dtype)
    settled = known[rows]
    best[settled] = squared_each(x[rows[settled]], c[own[rows[settled]]])
    taken += int(settled.sum())
    upper[rows] = np.minimum(upper[rows], up(best))
    left = ~(upper[rows] < lower[rows].min(1))
    rows, best = rows[left], best[left]

    before, number = best.copy(), own[rows]
    number = np.where(number < 0, len(c), number)
    first = np.full((len(rows), lower.shape[1]), -1)  # nearest of a scanned group
    nearest, second = np.full(first.shape, worst, x.dtype), np.full(first.shape, worst, x.dtype)
    for g in range(lower.shape[1]):
        near = np.flatnonzero(lower[rows, g] <= up(best))
        members = np.flatnonzero(group == g)
        d = squared(x[rows[near]], c[members])
        taken += d.size
        at = d.argmin(1) if len(near) else np.zeros(0, np.int64)
        line = np.arange(len(near))
        first[near, g], nearest[near, g] = members[at], d[line, at]
        d[line, at] = worst
        second[near, g] = d.min(1, initial=worst)
        better = (nearest[near, g] < best[near]) | ((nearest[near, g] == best[near]) & (members[at] < number[near]))
        best[near] = np.where(better, nearest[near, g], best[near])
        number[near] = np.where(better, members[at], number[near])

    scanned = first >= 0
    lower[rows] = np.where(scanned, down(np.where(first == number[:, None], second, nearest)), lower[rows])
    # the centroid that was left, if its group wasn't scanned
    gone = np.flatnonzero((number != own[rows]) & (own[rows] >= 0))
    left_group = group[own[rows[gone]]]
    lower[rows[gone], left_group] = np.minimum(lower[rows[gone], left_group], np.where(scanned[gone, left_group], np.inf, down(before[gone])))
    own[rows], upper[rows] = number, up(best)
    return own, upper, lower, taken


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def _round(key: str, centroids: np.ndarray, group: np.ndarray, moved: np.ndarray, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, lower = matrix(batch.column("v"), centroids.shape[1]), matrix(batch.column("lower"), int(group.max()) + 1, np.float64)
            own, upper, lower, _ = assigned(x, np.asarray(batch.column("cluster")).astype(np.int64), np.asarray(batch.column("upper")), lower, centroids, group, moved)
            keys, cluster = batch.column(key), pa.array(own, pa.int32())
            if last:
                a, b = exact(x, centroids)
                yield pa.RecordBatch.from_arrays([keys, cluster, pa.array(squared_each(a, b[own]).astype(np.int64))], [key, "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([keys, batch.column("v"), cluster, pa.array(upper), _lists(lower, pa.float64())], [key, *BOUNDS.names])

    return run


def _centroid_sums(table: DataFrame, dims: int) -> list:
    """A row a cluster: its number, count and component sums."""
    return table.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("v", F.lit(i)).cast("long")) for i in range(dims)]).alias("total")).collect()


def clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Rows (key, cluster, distance) of all vectors that count, and the centroids' components."""
    held = vectors.where((F.size(vector) == dims) & finite(F.col(vector))).select(key, whole(F.col(vector), scale).alias("v"))
    held = stored(held, "cluster-vectors")
    chosen = F.sha2(F.concat(F.lit(SALT), F.col(key).cast("string")), 256)
    centroids = np.array([r["v"] for r in held.orderBy(chosen.asc_nulls_last(), "v").select("v").limit(k).collect()], dtype=np.int64).reshape(-1, dims)
    kind = held.schema[key].dataType.simpleString()
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, cluster int, distance bigint"), centroids
    group, moved = grouped(centroids), np.zeros(len(centroids))
    table = held.select(key, "v", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.array_repeat(F.lit(0.0), int(group.max()) + 1).alias("lower"))
    before = held
    for _ in range(rounds):
        step = table.mapInArrow(_round(key, centroids, group, moved, False), f"`{key}` {kind}, v array<int>, cluster int, upper double, lower array<double>")
        table = stored(step, "cluster-round")
        drop(before)
        before, new = table, centroids.copy()
        for r in _centroid_sums(table, dims):
            new[r["cluster"]] = [s // r["n"] for s in r["total"]]
        moved, centroids = up(squared_each(*exact(new, centroids))), new
    last = stored(table.mapInArrow(_round(key, centroids, group, moved, True), f"`{key}` {kind}, cluster int, distance bigint"), "clusters")
    drop(before)
    return last, centroids


def report(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, centroids = clusters(vectors, key, vector)
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid at most
    of_cluster = F.array(*[F.lit(sums.get(i, 0)).cast("long") for i in range(len(centroids))] or [F.lit(0).cast("long")])
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()] or [F.lit("")])
    return rows.select(key, "cluster", "distance", F.get(of_cluster, "cluster").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), F.get(digests, "cluster").alias("centroid_sha256"))

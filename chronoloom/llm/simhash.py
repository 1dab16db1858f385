"""SimHash near-duplicates by a binary trie self-join.

A text's fingerprint has a bit where more than half of its shingles' 64-bit
hashes have it. Distinct fingerprints are put into binary tries; a join of a
trie with itself walks pairs of nodes downwards together, counts the bits in
which their paths differ, and drops a pair as soon as it has more than the
budget, or when one side is empty.

The tries are dealt over the cluster by pigeonhole: fingerprints that differ in
at most 2 of 64 bits agree on at least one of three blocks of bits. For each
block the fingerprint's bits are ordered so that this block leads; the block's
value is the trie's root path, on which no bit may differ, and keys the shuffle.
One task walks many tries at once, level by level, in numpy.

A trie with more than ``limit`` fingerprints is dealt again in the same way: the
budget goes down to the bits that its members need not share, which are cut into
three blocks, so every pair still meets in a trie of one of them. Members of
large tries are counted before they are shuffled and never pass through one task.
With ``LAST_BITS`` free bits a trie has few members and is walked in any case.

Links become components by alternating large-star and small-star steps, each
written to the shared folder. Neither links nor fingerprints reach the driver.

Null and empty texts have fingerprint zero and are linked like any other. Very
long texts are read whole. A null key takes part and gets its component's
smallest key. Repeated rows have equal results, and ties don't arise, as a
fingerprint has one component. Rows that share a key belong together only if
their fingerprints link. Other columns are not read; ``one_of_each`` carries
them along whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.shared import arrow_function, drop, stored, unused

SHINGLE, SEED, BUDGET = 3, 42, 2
#: Blocks into which free bits are cut, one more than the budget.
BLOCKS = BUDGET + 1
#: A trie of more fingerprints is dealt again; more for very large corpora, whose tries of a first block all have more.
LIMIT = 4096
#: A trie with so few free bits is walked whatever its size, which they bound.
LAST_BITS = 12
#: Tries walked together hold about so many fingerprints.
TOGETHER = 16_384
_SLICE = 1 << 16


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(own) - SHINGLE + 1)
    starts, stops = first[:n].tolist(), ends[min(SHINGLE, len(own)) - 1 :][:n].tolist()
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, _SLICE):
        hashes = np.array([digest(joined[x:y], SEED) for x, y in zip(starts[a : a + _SLICE], stops[a : a + _SLICE], strict=True)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@arrow_function("bigint")
def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array(np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64))


def linked_pairs(values: np.ndarray, group: np.ndarray, depth: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``budget`` bits, by walking node pairs of every group's trie together.

    values: rotated fingerprints, distinct and sorted inside a group. group: first index of each group and the
    end. depth: leading bits that a group shares. A node is a range of indexes whose values share a path.
    """
    n, size = len(values), np.diff(group)
    keep = size > 1
    a0, a1 = group[:-1][keep], group[1:][keep]
    b0, b1, left = a0, a1, np.full(len(a0), budget)
    wait = depth[keep]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    later = [(d, *(x[wait == d] for x in (a0, a1, b0, b1, left))) for d in np.unique(wait)]
    a0 = a1 = b0 = b1 = left = np.zeros(0, dtype=np.int64)
    for level in range(64):
        for d, *own in later:
            if d == level:
                a0, a1, b0, b1, left = (np.concatenate(x) for x in zip((a0, a1, b0, b1, left), own, strict=True))
        if not len(a0):
            continue
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - level)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # where the ones begin
        same = a0 == b0
        some = ~same
        parts = [
            (a0, am, b0, bm, left),  # zeros with zeros
            (am, a1, bm, b1, left),  # ones with ones
            (a0, am, bm, b1, left - 1),  # zeros with ones
            tuple(x[some] for x in (am, a1, b0, bm, left - 1)),  # ones with zeros, which a node paired with itself has had
        ]
        a0, a1, b0, b1, left = (np.concatenate(x) for x in zip(*parts, strict=True))
        own = a0 == b0
        alive = (left >= 0) & (a1 > a0) & (b1 > b0) & ~(own & (a1 - a0 < 2))
        a0, a1, b0, b1, left = (x[alive] for x in (a0, a1, b0, b1, left))
        single = (a1 - a0 == 1) & (b1 - b0 == 1)  # two leaves: the rest of their paths at once
        if single.any():
            i, j = a0[single], b0[single]
            rest = np.uint64((1 << (63 - level)) - 1)
            near = np.bitwise_count((values[i] ^ values[j]) & rest) <= left[single]
            found.append((i[near], j[near]))
            a0, a1, b0, b1, left = (x[~single] for x in (a0, a1, b0, b1, left))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def bits_of(path: int) -> tuple[list[int], list[int]]:
    """Bits, from 0 on the left, that the tries of a path share, and the free ones. A path is 1, then a digit below BLOCKS for the block chosen at each dealing."""
    shared, free, digits = [], list(range(64)), []
    while path > 1:
        path, digit = divmod(path, BLOCKS)
        digits.append(digit)
    for digit in reversed(digits):
        at = [len(free) * k // BLOCKS for k in range(BLOCKS + 1)]
        shared += free[at[digit] : at[digit + 1]]
        free = free[: at[digit]] + free[at[digit + 1] :]
    return shared, free


def arranged(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """Fingerprints with their bits in another order."""
    out = np.zeros(len(fp), np.uint64)
    k = 0
    while k < len(bits):
        n = 1
        while k + n < len(bits) and bits[k + n] == bits[k] + n:
            n += 1
        run = (fp >> np.uint64(64 - bits[k] - n)) & np.uint64((1 << n) - 1)
        out |= run << np.uint64(64 - k - n)
        k += n
    return out


TRIES = "path int, key bigint, value bigint, fp bigint"
TRIES_ARROW = pa.schema([("path", pa.int32()), ("key", pa.int64()), ("value", pa.int64()), ("fp", pa.int64())])


def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, fp) to one row for each block of the path's free bits: its path, the shared bits as key, all bits in the trie's order."""
    for batch in batches:
        path, fp = (batch.column(k).to_numpy() for k in range(2))
        for parent in np.unique(path).tolist():
            own = fp[path == parent]
            for block in range(BLOCKS):
                child = parent * BLOCKS + block
                shared, free = bits_of(child)
                value = arranged(own.view(np.uint64), shared + free)
                key = value >> np.uint64(64 - len(shared))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), child, np.int32)), pa.array(key.view(np.int64)), pa.array(value.view(np.int64)), pa.array(own)], schema=TRIES_ARROW)


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, key, value, fp) in order to links: u with its root v."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    depth_of: dict[int, int] = {}

    def links(path: np.ndarray, key: np.ndarray, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (key[1:] != key[:-1])]))
        for p in np.unique(path).tolist():
            depth_of.setdefault(p, len(bits_of(p)[0]))
        i, j = linked_pairs(value.view(np.uint64), np.append(new, len(fp)), np.array([depth_of[p] for p in path[new].tolist()]))
        root = roots(len(fp), i, j)
        at = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[root[at]])], schema=schema)

    held = [np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.int64)]
    for batch in batches:
        held = [np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate(held)]
        if len(held[0]) < TOGETHER:
            continue
        new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
        if len(new):  # the trie of the last rows may go on
            yield links(*(x[: new[-1]] for x in held))
            held = [x[new[-1] :] for x in held]
    if len(held[0]):
        yield links(*held)


def links(fingerprints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (u, v) between distinct fingerprints, enough to connect every component. fingerprints: one column ``fp``, distinct."""
    left, found, free = fingerprints.select(F.lit(1).alias("path"), "fp"), None, 64
    while True:
        tries = left.mapInArrow(dealt, TRIES)
        free -= free // BLOCKS
        large = None
        if free > LAST_BITS:
            large = stored(tries.groupBy("path", "key").agg(F.count("*").alias("n")).where(F.col("n") > limit).drop("n"), "large-tries")
            large = None if large.isEmpty() else large
        small = tries if large is None else tries.join(large, ["path", "key"], "left_anti")
        near = stored(small.repartition("path", "key").sortWithinPartitions("path", "key", "value").mapInArrow(walked, "u bigint, v bigint"), "simhash-links")
        found = near if found is None else found.unionByName(near)
        if large is None:
            return found
        left = stored(tries.join(large, ["path", "key"], "left_semi").select("path", "fp"), "large-tries")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); root is the smallest node of the component."""
    now = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == before or not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that adaptive execution may split the join at a node of very many links
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least-neighbours")
        # large star: every larger neighbour goes to the smallest one
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: every smaller neighbour goes to the smallest one
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, stored(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop(last, least)


def _linked(fingerprints: DataFrame, limit: int | None) -> DataFrame:
    """(node, root) for the distinct fingerprints that are near another one."""
    if limit is None:
        limit = max(LIMIT, 8 * fingerprints.count() >> 64 // BLOCKS)
    return components(links(fingerprints, limit))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int | None = None) -> DataFrame:
    """One row per text: key, fingerprint (16 hexadecimal digits), component_id (smallest key of the component)."""
    prints = stored(docs.select(F.col(key), simhash(F.col(text)).alias("fp")), "fingerprints")
    least = stored(prints.groupBy("fp").agg(F.min(key).alias("least")), "distinct-fingerprints")
    found = _linked(least.select("fp"), limit)
    rooted = least.join(found, least["fp"] == found["node"]).groupBy("root").agg(F.min("least").alias("component_id"))
    joined = found.join(rooted, "root").select(F.col("node").alias("fp"), "component_id")
    named = least.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # written, so that adaptive execution may split the join where one fingerprint has a third of the rows
    named = stored(named, "fingerprint-components")
    return prints.join(named, "fp").select(F.col(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest key, then of the smallest hash. Rows without a key come last in their component. Keys may repeat."""
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(*docs.columns).alias("hash"))
    prints = stored(docs.select(row.alias("row"), simhash(F.col(text)).alias("fp")), "fingerprints")
    least = stored(prints.groupBy("fp").agg(F.min("row").alias("row")), "distinct-fingerprints")
    found = _linked(least.select("fp"), None)
    name = unused(docs, "row")[0]
    first = least.join(found, least["fp"] == found["node"], "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("row").alias(name)).select(name)
    return docs.withColumn(name, row).join(first, name, "left_semi").dropDuplicates([name]).select(*docs.columns)

"""Similarity search, graph walks and label propagation on edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.storage import drop, stored


def cosine_topk(queries: DataFrame, items: DataFrame, k: int, block_rows: int = 5000, key: str = "vec_id", vector: str = "embedding", side: str = "both") -> DataFrame:
    """The k most similar items of each query: qid, key, cosine; ties go to the smaller key, an item doesn't find itself, zero vectors have cosine 0. ``side`` may restrict a query to items of smaller ("before") or larger ("after") key.

    The stated queries go to all tasks in blocks of ``block_rows``; a task keeps the
    best k of its part for every query, so what is shuffled is k rows per query
    and part. Items are read once a block, and compared so few at a time that a task's
    products stay under ``PRODUCTS``, whatever the size of an Arrow batch.
    """
    n = queries.count()
    blocks = max(1, -(-n // block_rows))
    found = None
    for b in range(blocks):
        rows = sorted(queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).select(key, vector).collect())  # about block_rows
        if not rows:
            continue
        ids, q = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def best(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            found = _Best(ids, q, k, hidden=HIDDEN[side])
            step = max(k + 1, PRODUCTS // len(ids))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    some = batch.slice(at, step)
                    found.add(some.column(key).to_numpy(), _units(_matrix(some.column(vector))))
            yield pa.RecordBatch.from_pydict({"qid": found.ids[found.held[0]], key: found.held[1], "cosine": found.held[2]}, pa.schema([("qid", pa.int64()), (key, pa.int64()), ("cosine", pa.float64())]))

        part = items.select(F.col(key).cast("long").alias(key), vector).mapInArrow(best, f"qid bigint, {key} bigint, cosine double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.sparkSession.createDataFrame([], f"qid bigint, {key} bigint, cosine double")
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("d"), F.col(key)))), 1, k)
    return found.groupBy("qid").agg(top.alias("t")).select("qid", F.explode("t").alias("x")).select("qid", F.col(f"x.{key}"), (-F.col("x.d")).alias("cosine"))


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)


#: Cosines that a search takes at a time in a task, and the keys (of queries, of items) that a side hides.
PRODUCTS = 1 << 21
HIDDEN = {"both": np.equal, "before": np.less_equal, "after": np.greater_equal}


class _Best:
    """The k best of all items that have been seen, for each of some queries."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None, hidden=np.equal):
        self.ids, self.q, self.k, self.hidden = ids, q, k, hidden
        self.least = np.full(len(ids), -np.inf) if least is None else least
        self.held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]

    def add(self, own: np.ndarray, x: np.ndarray) -> None:
        cos = self.q @ x.T
        cos[self.hidden(self.ids[:, None], own[None, :])] = -np.inf
        floor = self.least
        if cos.shape[1] > self.k and not np.isfinite(self.least).all():
            floor = np.maximum(self.least, np.partition(cos, cos.shape[1] - self.k, axis=1)[:, cos.shape[1] - self.k])
        r, c = np.nonzero((cos >= floor[:, None] - 2e-9) & (cos > -2))
        held = [np.r_[self.held[0], r], np.r_[self.held[1], own[c]], np.r_[self.held[2], np.round(cos[r, c], 9)]]
        order = np.lexsort((held[1], -held[2], held[0]))
        held = [h[order] for h in held]
        first = np.searchsorted(held[0], held[0])
        kept = np.arange(len(first)) - first < self.k
        self.held = held = [h[kept] for h in held]
        n = np.bincount(held[0], minlength=len(self.ids))
        full = np.cumsum(n)[n == self.k] - 1
        self.least = self.least.copy()
        self.least[n == self.k] = np.maximum(self.least[n == self.k], held[2][full])


#: Pivots around which items are put together, most blocks of items, queries that one task puts to a block.
PIVOTS, BLOCKS, ASKED = 256, 50_000, 20_000


def nearest_of_all(items: DataFrame, k: int, block_rows: int = 2000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k most similar items of every item: qid, key, cosine, with the ties and zero vectors of ``cosine_topk``. See ``neighbour_asks``."""
    if items.isEmpty():
        return items.sparkSession.createDataFrame([], f"qid bigint, {key} bigint, cosine double")
    packed, asks = neighbour_asks(items, k, block_rows, key, vector)
    found = answers(packed, asks.select(F.explode("asks").alias("block"), "qid", "vector", "least"), k, key)
    near = asks.select("qid", F.explode("found").alias("x")).select("qid", F.col("x.key").alias(key), "x.cosine")
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("d"), F.col(key)))), 1, k)
    return near.unionByName(found).groupBy("qid").agg(top.alias("t")).select("qid", F.explode("t").alias("x")).select("qid", F.col(f"x.{key}"), (-F.col("x.d")).alias("cosine"))


def answers(packed: DataFrame, asked: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """The k most similar items of the blocks (block, rows) that queries (block, qid, vector, least) name, a query and block at a time; ones below ``least`` are left out. Blocks that many queries name are copied, not the queries gathered."""
    n = asked.groupBy("block").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("salts"))
    salts = F.broadcast(n)  # a row a block: BLOCKS and the pivots at most
    none = lambda kind: F.lit(None).cast(kind)
    kinds = dict(asked.dtypes)
    held = packed.join(salts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("asks"), none("bigint").alias("qid"), none(kinds["vector"]).alias("vector"), none("double").alias("least"), "rows")
    asking = asked.join(salts, "block").select("block", F.pmod(F.xxhash64("qid"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("asks"), "qid", "vector", "least", none(dict(packed.dtypes)["rows"]).alias("rows"))
    dealt = held.unionByName(asking).repartition("block", "salt").sortWithinPartitions("block", "salt", "asks")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting = None, []

        def answered(asked: pa.RecordBatch) -> pa.RecordBatch:
            found = _Best(asked.column("qid").to_numpy(), _units(_matrix(asked.column("vector"))), k, asked.column("least").to_numpy())
            found.add(*block)
            return pa.RecordBatch.from_pydict({"qid": found.ids[found.held[0]], key: found.held[1], "cosine": found.held[2]}, pa.schema([("qid", pa.int64()), (key, pa.int64()), ("cosine", pa.float64())]))

        for batch in batches:
            own = np.asarray(batch.column("asks")) == 0
            if own.any():
                rows = batch.column("rows").slice(int(own.argmax()), 1).flatten()
                block = rows.field("key").to_numpy(zero_copy_only=False), _units(_matrix(rows.field("vector")))
            asking = batch.filter(pa.array(~own))
            if block is None:
                waiting.append(asking)
                continue
            for part in [*waiting, asking]:
                for at in range(0, part.num_rows, 1000):
                    yield answered(part.slice(at, 1000))
            waiting = []

    return dealt.groupBy("block", "salt").applyInArrow(best, f"qid bigint, {key} bigint, cosine double")


def neighbour_asks(items: DataFrame, k: int, block_rows: int = 2000, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Blocks of items (block, rows), and for each item what its own block gives (found), its k-th best cosine there (least), and the other blocks that could hold a better one (asks).

    Items go to the nearest of up to PIVOTS items, drawn by hash; those of a pivot are cut into
    blocks of about ``block_rows`` (more if there would be over BLOCKS blocks), so a vector that
    a third of all rows share is many blocks. A block knows the largest distance of its items
    from the pivot. By the triangle inequality none of them is nearer to a query than the
    query's distance to the pivot less that radius; a block for which this rules out the k-th
    best is not asked. Zero vectors, which are near nothing, are in blocks that all ask, and ask
    all. Pivots and a row a block go to the tasks.
    """
    n = items.count()
    rows = max(block_rows, -(-n // BLOCKS))
    drawn = items.select(key, vector).orderBy(F.xxhash64(key), key).limit(min(PIVOTS, -(-n // rows))).collect()
    pivots = _units(np.array([r[1] for r in drawn], dtype=np.float64))
    pivots = np.unique(pivots[np.linalg.norm(pivots, axis=1) > 0], axis=0)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _units(_matrix(batch.column("vector")))
            zero = ~x.any(axis=1)
            cos = x @ pivots.T if len(pivots) else np.zeros((len(x), 1))
            cell = np.where(zero, 0, 1 + cos.argmax(axis=1))
            away = np.where(zero, np.inf, np.sqrt(np.maximum(2 - 2 * cos.max(axis=1), 0)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vector"), pa.array(cell, pa.int32()), pa.array(away)], ["key", "vector", "cell", "away"])

    own = items.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    cells = stored(own.mapInArrow(placed, f"key bigint, vector {dict(own.dtypes)['vector']}, cell int, away double"), "vector-cells")
    count = {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a pivot
    parts = [-(-count.get(c, 0) // rows) for c in range(len(pivots) + 1)]
    begins = np.cumsum([0, *parts]).tolist()
    block = F.get(F.array(*map(F.lit, begins)), "cell") + F.pmod(F.xxhash64("key"), F.get(F.array(*[F.lit(max(x, 1)) for x in parts]), "cell"))
    packed = stored(cells.select(block.cast("int").alias("block"), "cell", "away", F.struct("key", "vector").alias("row")).groupBy("block").agg(F.first("cell").alias("cell"), F.max("away").alias("radius"), F.collect_list("row").alias("rows")), "vector-blocks")
    known = sorted(tuple(r) for r in packed.select("block", "cell", "radius").collect())  # a row a block
    ids, cell, radius = (np.array(x) for x in zip(*known, strict=True))

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = batch.column("rows").slice(i, 1).flatten()
                own, x = held.field("key").to_numpy(zero_copy_only=False), _units(_matrix(held.field("vector")))
                for at in range(0, len(own), 100):
                    part = slice(at, at + 100)
                    best = _Best(own[part], x[part], k)
                    best.add(own, x)
                    zero = ~x[part].any(axis=1)
                    away = np.sqrt(np.maximum(2 - 2 * (x[part] @ pivots.T), 0)) if len(pivots) else np.zeros((len(x[part]), 0))
                    away = np.concatenate([np.zeros((len(away), 1)), away], axis=1)[:, cell]
                    apart = np.maximum(away - radius[None, :] - 1e-7, 0)
                    asks = (1 - apart * apart / 2 >= best.least[:, None] - 4e-9) | ~np.isfinite(radius)[None, :] | zero[:, None]
                    asks[:, ids == batch.column("block")[i].as_py()] = False
                    found = [[] for _ in best.ids]
                    for r, other, cosine in zip(*best.held, strict=True):
                        found[r].append({"key": int(other), "cosine": float(cosine)})
                    kind = pa.list_(pa.struct([("key", pa.int64()), ("cosine", pa.float64())]))
                    yield pa.RecordBatch.from_arrays([pa.array(best.ids), held.field("vector")[at : at + 100], pa.array(found, kind), pa.array(best.least), pa.array([ids[a].tolist() for a in asks], pa.list_(pa.int32()))], ["qid", "vector", "found", "least", "asks"])

    asks = stored(packed.select("block", "rows").mapInArrow(asking, f"qid bigint, vector {dict(own.dtypes)['vector']}, found array<struct<key:bigint,cosine:double>>, least double, asks array<int>"), "neighbour-asks")
    drop(cells)
    return packed.select("block", "rows"), asks


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, root): the smallest node of each component of undirected edges (a, b). Labels spread along edges and jump to their own label's label; each round is a written table."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    labels, before = both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), None
    for _ in range(most):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        low = labels.join(near, labels["node"] == near["a"], "left").select("node", "root", F.least("root", F.coalesce("m", "root")).alias("new"))
        jump = low.select(F.col("node").alias("_n"), F.col("new").alias("_r"))
        new = stored(low.join(jump, low["new"] == jump["_n"]).select("node", F.col("root").alias("old"), F.least("new", "_r").alias("root")), "labels")
        done = new.where("old != root").isEmpty()
        if before is not None:
            drop(before)
        labels, before = new.select("node", "root"), new
        if done:
            drop(both)
            return labels
    raise RuntimeError("components did not settle")


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop): least number of directed edges (a, b) from a seed, up to ``hops``."""
    reached = seeds.select("node", F.lit(0).alias("hop")).distinct()
    front = reached
    for h in range(1, hops + 1):
        front = front.join(edges, front["node"] == edges["a"]).select(F.col("b").alias("node")).distinct().join(reached, "node", "left_anti").withColumn("hop", F.lit(h))
        reached = reached.unionByName(front)
    return reached


def reached_windows(nodes: DataFrame, edges: DataFrame, same: DataFrame, hops: int = 2, each: int = 2, by: str = "gid") -> DataFrame:
    """The nearest windows on either side that a window's nodes reach: (by, window, found, hop).

    nodes: (by, window, node); windows of a group are numbered in time order. edges and
    same: undirected (a, b). An edge of ``same`` costs nothing, so what it ties is one
    node; other edges cost a hop. On each side the ``each`` nearest are kept, with the
    least number of hops. Of every node reached only the nearest windows that hold it
    are looked up, by windows over its own list, so a node that stands in all windows
    of a group makes no pairs of them.
    """
    tied = components(same).select("node", "root")
    named = stored(nodes.join(tied, "node", "left").select(by, "window", "node", F.coalesce("root", "node").alias("root")), "walk-nodes")
    roots = named.select("node", "root").distinct()
    ends = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    joined = edges.select("a", "b").join(ends("a"), "a").join(ends("b"), "b").where("ra != rb")
    both = stored(joined.select(F.col("ra").alias("a"), F.col("rb").alias("b")).union(joined.select("rb", "ra")).distinct(), "walk-edges")
    at = named.select(by, "window", "root").distinct()
    key = [by, "window", "root"]
    reached = at.withColumn("hop", F.lit(0))
    front = reached
    for h in range(1, hops + 1):
        moved = front.join(both, front["root"] == both["a"]).select(by, "window", F.col("b").alias("root")).distinct()
        front = stored(moved.join(reached, key, "left_anti").withColumn("hop", F.lit(h)), "walk-front")
        reached = reached.unionByName(front)
    inside = W.partitionBy(by, "root").orderBy("window")
    beside = lambda f: F.array(F.col("window"), *[f("window", k).over(inside) for k in range(1, each)])
    own = at.select(*key, F.lit(None).cast("int").alias("hop"), F.struct(beside(F.lag).alias("back"), beside(F.lead).alias("ahead")).alias("own"))
    stream = reached.withColumn("own", F.lit(None).cast(own.schema["own"].dataType)).unionByName(own)
    asked = F.col("own").isNull()
    before = W.partitionBy(by, "root").orderBy("window", F.when(asked, 0).otherwise(1)).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(by, "root").orderBy("window", F.when(asked, 1).otherwise(0)).rowsBetween(1, W.unboundedFollowing)
    found = stream.select(*key, "hop", asked.alias("asked"), F.last("own", True).over(before).alias("b"), F.first("own", True).over(after).alias("f")).where("asked")
    none = F.array().cast("array<bigint>")
    pairs = found.select(by, "window", "hop", F.explode(F.concat(F.coalesce("b.back", none), F.coalesce("f.ahead", none))).alias("found")).where("found is not null")
    least = pairs.groupBy(by, "window", "found").agg(F.min("hop").alias("hop"))
    side = W.partitionBy(by, "window", F.col("found") < F.col("window")).orderBy(F.abs(F.col("found") - F.col("window")))
    return least.withColumn("_r", F.row_number().over(side)).where(F.col("_r") <= each).drop("_r")


def propagate(edges: DataFrame, values: DataFrame, rounds: int, keep: float) -> DataFrame:
    """Node values mixed with the softmax-weighted mean of their neighbours: v = keep * v + (1 - keep) * sum(softmax(w) * v_neighbour)."""
    weights = edges.select("a", "b", F.exp("w").alias("e"))
    total = weights.groupBy("a").agg(F.sum("e").alias("z"))
    share = weights.join(total, "a").select("a", "b", (F.col("e") / F.col("z")).alias("p"))
    now = values
    for _ in range(rounds):
        moved = share.join(now, share["b"] == now["node"]).groupBy("a").agg(F.sum(F.col("p") * F.col("v")).alias("m"))
        now = now.join(moved, now["node"] == moved["a"], "left").select("node", F.when(F.col("m").isNull(), F.col("v")).otherwise(keep * F.col("v") + (1 - keep) * F.col("m")).alias("v"))
    return now


def node_scores(edges: DataFrame, tolerance: float = 1e-10, most: int = 500) -> DataFrame:
    """(node, score): scores whose differences fit the values of edges (a, b, v), v for a less b, best; of mean zero in each component.

    Conjugate gradients on the edge table: a step is a join with the edges and a few sums. Equal edges
    are summed first, loops and edges without a value say nothing. Each step is a written table; there
    is no matrix of nodes. ``tolerance`` is that of the residual against the right-hand side.
    """
    own = edges.where("a != b and v is not null").select("a", "b", F.col("v").cast("double").alias("v"))
    ways = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("v")).alias("v")))
    both = stored(ways.groupBy("a", "b").agg(F.count("*").alias("w"), F.sum("v").alias("v")), "score-edges")
    start = both.groupBy("a").agg(F.sum("v").alias("r"), F.sum("w").alias("d")).select(F.col("a").alias("node"), F.lit(0.0).alias("x"), "r", F.col("r").alias("p"), "d")
    state, kept, first = start, None, None
    for _ in range(most):
        moved = both.join(state.select(F.col("node").alias("b"), "p"), "b").groupBy("a").agg(F.sum(F.col("w") * F.col("p")).alias("m"))
        step = stored(state.join(moved.withColumnRenamed("a", "node"), "node").select("node", "x", "r", "p", "d", (F.col("d") * F.col("p") - F.col("m")).alias("q")), "score-step")
        drop(*([kept] if kept is not None else []))
        kept = step
        s = step.agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("p") * F.col("q")).alias("pq")).first()
        first = s["rr"] if first is None else first
        if not s["rr"] or not s["pq"] or s["rr"] <= tolerance**2 * first:
            break
        along = s["rr"] / s["pq"]
        r = F.col("r") - along * F.col("q")
        after = step.agg(F.sum(r * r).alias("rr")).first()["rr"]
        state = step.select("node", (F.col("x") + along * F.col("p")).alias("x"), r.alias("r"), (r + after / s["rr"] * F.col("p")).alias("p"), "d")
    drop(both)
    return kept.select("node", F.col("x").alias("score"))


#: Blocks of positions that are one row of the table; blocks of it that are met with those of another row at a time.
WIDE, STRIP = 50, 10


def position_graph(items: DataFrame, block: int, most: int, least: int, alpha: float, gamma: float, by: str = "gid", digits: int | None = None) -> DataFrame:
    """Rows (by, idx, look, motion), positions from 0 without gaps, to undirected edges (by, a, b, w) with a < b.

    w = (alpha * cosine of looks + (1 - alpha) * exp(-distance of motions)) / (1 + gamma |a - b|), rounded to ``digits``. In each
    block of ``block`` positions a row keeps its k best positive weights (of equals the smaller positions; its own place counts);
    k falls from ``most`` to ``least`` by one a tenth of the series that the row's block begins after. An edge is kept if either
    end keeps it. So the edges are a share of all pairs. Each pair of parts of WIDE blocks is met once in one task, in strips of
    bounded memory, so a long series is many tasks, and its rows are shuffled once a part and not once a block.
    """
    wide = block * WIDE
    own = F.struct("idx", "look", "motion")
    parts = items.groupBy(by, F.floor(F.col("idx") / wide).alias("part")).agg(F.array_sort(F.collect_list(own)).alias("rows"))
    packed = stored(parts, "position-parts")
    sizes = packed.groupBy(by).agg(F.sum(F.size("rows")).alias("n"))
    parts_of = F.ceil(F.col("n") / wide)
    total = sizes.agg(F.sum(parts_of * (parts_of + 1) / 2).cast("long").alias("pairs")).first()["pairs"] or 1
    later = packed.join(sizes, by).select(by, "n", "part", "rows", F.explode(F.sequence("part", parts_of - 1)).alias("other"))
    pairs = later.join(packed.select(by, F.col("part").alias("other"), F.col("rows").alias("others")), [by, "other"])

    def matrix(rows: pa.StructArray, name: str) -> np.ndarray:
        lists = rows.field(name)
        if len(pc.unique(pc.list_value_length(lists))) > 1:
            raise ValueError(f"{name}: vectors of different lengths")
        return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)

    def best(w: np.ndarray, at: np.ndarray, tenth: int) -> np.ndarray:
        """Which of each block of columns the rows, at these positions, keep."""
        k = np.minimum(np.maximum(least, most - at // block * block // tenth), block)
        keys = np.full((len(w), -(-w.shape[1] // block) * block), np.inf)
        keys[:, : w.shape[1]] = -np.round(w, 12)
        keys = keys.reshape(len(w), -1, block)
        last = np.take_along_axis(np.sort(keys, axis=2), np.broadcast_to((k - 1)[:, None, None], (*keys.shape[:2], 1)), axis=2)
        found = keys <= last
        x, y = np.nonzero(found.sum(axis=2) > k[:, None])  # of those equal to the last the first
        before, equal = keys[x, y] < last[x, y], keys[x, y] == last[x, y]
        found[x, y] = before | equal & (np.cumsum(equal, axis=1) + before.sum(axis=1, keepdims=True) <= k[x][:, None])
        return found.reshape(len(w), -1)[:, : w.shape[1]]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = [batch.column(c).slice(i, 1).flatten() for c in ("rows", "others")]
                at = [s.field("idx").to_numpy() for s in sides]
                looks = [matrix(s, "look") for s in sides]
                looks = [x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-6) for x in looks]
                motion = [matrix(s, "motion") for s in sides]
                tenth = max(1, batch.column("n")[i].as_py() // 10)
                for low in range(0, len(at[0]), STRIP * block):
                    rows, cols = slice(low, low + STRIP * block), slice(low if at[0][0] == at[1][0] else 0, None)  # in a part with itself from the strip on
                    a, b = at[0][rows], at[1][cols]
                    away = np.sqrt(sum((motion[0][rows, None, c] - motion[1][None, cols, c]) ** 2 for c in range(motion[0].shape[1])))
                    w = (alpha * looks[0][rows] @ looks[1][cols].T + (1 - alpha) * np.exp(-away)) / (1 + gamma * np.abs(a[:, None] - b[None]))
                    x, y = np.nonzero((best(w, a, tenth) | best(w.T, b, tenth).T) & (w > 0) & (a[:, None] < b[None]))
                    kept = w[x, y] if digits is None else np.round(w[x, y], digits)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(by)[i].as_py()] * len(x), batch.schema.field(by).type), pa.array(a[x], pa.int64()), pa.array(b[y], pa.int64()), pa.array(kept)], [by, "a", "b", "w"])

    spread = pairs.repartition(max(min(total, 1000), total // 16), by, "part", "other")  # few bytes make many edges
    return spread.select(by, "n", "rows", "others").mapInArrow(edges, f"{by} {dict(items.dtypes)[by]}, a bigint, b bigint, w double")

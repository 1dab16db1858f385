"""Greedy one-to-one pairs of two sides, from the greatest similarity downwards, without one task that sorts all pairs.

Pairs are ordered by similarity, then by the two keys. The first pair of all that are
left is the best of both its members; so are other pairs, and all that are the best of
both their members may be made at once: no greedy choice comes between. Each member
keeps a list of its best candidates. A round makes the pairs that stand first in both
lists and strikes their members from all lists. Members whose list has run out while
both sides have members left get a new one, against what is left of the other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.graphs import answers
from chronoloom.storage import drop, stored


def _packed(side: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    blocks = max(1, -(-side.count() // block_rows))
    rows = side.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), F.struct("key", "vector").alias("row"))
    return rows.groupBy("block").agg(F.collect_list("row").alias("rows")), blocks


def _lists(asking: DataFrame, other: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(me, you, cosine): the k best of the other side for each row that asks. A key may be on both sides, so it is moved out of the way of the search, which leaves out a row's own key."""
    packed, blocks = _packed(other.select((2 * F.col("key")).alias("key"), "vector"), block_rows)
    asked = asking.select((2 * F.col("key") + 1).alias("qid"), "vector", F.lit(float("-inf")).alias("least"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = answers(packed, asked, k, "other").groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "other"))), 1, k).alias("t"))
    return found.select(F.shiftright("qid", 1).alias("me"), F.explode("t").alias("x")).select("me", F.shiftright("x.other", 1).alias("you"), (-F.col("x.d")).alias("cosine"))


def greedy_pairs(left: DataFrame, right: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, block_rows: int = 2000) -> DataFrame:
    """(a, b, cosine, round) of the pairs made; min(rows left, rows right) of them. Keys are unique on a side; equal cosines (to nine digits) go to the smaller a, then the smaller b; a zero vector has cosine 0."""
    sides = {n: stored(df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector")), "pair-side") for n, df in (("a", left), ("b", right))}
    lists = {"a": None, "b": None}
    pairs: DataFrame | None = None
    number = 0
    while not any(s.isEmpty() for s in sides.values()):
        for n, o in (("a", "b"), ("b", "a")):
            held = lists[n]
            empty = sides[n] if held is None else sides[n].join(held.select(F.col("me").alias("key")).distinct(), "key", "left_anti")
            if not empty.isEmpty():
                new = _lists(empty, sides[o], k, block_rows)
                lists[n] = stored(new if held is None else held.unionByName(new), "pair-lists")
                drop(*([held] if held is not None else []))
        first = lambda n: lists[n].groupBy("me").agg(F.min(F.struct((-F.col("cosine")).alias("d"), F.col("you"))).alias("t"))  # noqa: B023, E731
        best = {n: first(n).select(F.col("me").alias(n), F.col("t.you").alias(o), (-F.col("t.d")).alias("cosine")) for n, o in (("a", "b"), ("b", "a"))}
        number += 1
        made = stored(best["a"].join(best["b"].select("a", "b"), ["a", "b"]).withColumn("round", F.lit(number)), "pairs")
        pairs = made if pairs is None else pairs.unionByName(made)
        for n, o in (("a", "b"), ("b", "a")):
            gone = made.select(F.col(n).alias("me")), made.select(F.col(o).alias("you"))
            before = sides[n], lists[n]
            sides[n] = stored(sides[n].join(gone[0].withColumnRenamed("me", "key"), "key", "left_anti"), "pair-side")
            lists[n] = stored(lists[n].join(gone[0], "me", "left_anti").join(gone[1], "you", "left_anti").select("me", "you", "cosine"), "pair-lists")
            drop(*before)
    drop(*sides.values(), *[x for x in lists.values() if x is not None])
    return left.sparkSession.createDataFrame([], "a bigint, b bigint, cosine double, round int") if pairs is None else pairs

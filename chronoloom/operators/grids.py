"""Joins of series on one grid, curves from chunks, mirrored smoothing, indexes without repeats."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def truncated(score: DataFrame, gold: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of both at the same position of a key, so up to the shorter series, with n_score and n_gold, the rows of each. Keys of one side alone are left out."""
    n = [df.groupBy(key).agg(F.count("*").alias(name)) for df, name in ((score, "n_score"), (gold, "n_gold"))]
    return score.join(gold, [key, position]).join(n[0].join(n[1], key), key)


def equal(runs: list[DataFrame], key: str) -> DataFrame:
    """(key, n) of the keys that all runs have; an error that names the first key whose numbers of rows differ."""
    counts = [df.groupBy(key).agg(F.count("*").alias(f"n{k}")) for k, df in enumerate(runs)]
    both = reduce(lambda a, b: a.join(b, key), counts)
    names = [f"n{k}" for k in range(len(runs))]
    apart = F.size(F.array_distinct(F.array(*names))) > 1
    said = F.concat(F.lit("grids differ: "), F.col(key).cast("string"), F.lit(" "), F.concat_ws("/", *[F.col(c).cast("string") for c in names]))
    return both.where(F.when(apart, F.raise_error(said).cast("boolean")).otherwise(F.lit(True))).select(key, F.col("n0").alias("n"))


def chunk_curve(chunks: DataFrame, keys: DataFrame, n: int, rate: float, default: float, key: str = "gid") -> DataFrame:
    """(key, frame, v) for all keys and n frames: the mean of the chunks (key, start, end, v) over a frame, or the default. A chunk covers whole frames from the floor of its start to the ceiling of its end, one at least, inside the grid."""
    lo = F.greatest(F.floor(F.col("start") * rate), F.lit(0))
    hi = F.least(F.greatest(lo + 1, F.ceil(F.col("end") * rate)), F.lit(n))
    frames = chunks.select(key, "v", lo.alias("_lo"), hi.alias("_hi")).where("_hi > _lo")
    mean = frames.select(key, F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("frame"), "v").groupBy(key, "frame").agg(F.avg("v").alias("v"))
    every = keys.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("frame"))
    return every.join(mean, [key, "frame"], "left").select(key, "frame", F.coalesce("v", F.lit(default)).alias("v"))


def mirrored_smooth(series: DataFrame, value: str, sigma: float, radius: int, by: str = "gid", position: str = "idx", size: str = "n") -> DataFrame:
    """(by, position, v): Gaussian sums over ``radius`` positions on either side, the series continued by its own mirror image. Each position asks for its sources by a join, so a long series is no single task."""
    k = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * k * k / sigma**2)
    asked = F.explode(F.array(*[F.struct(F.lit(int(i)).alias("k"), F.lit(float(x)).alias("w")) for i, x in zip(k, w / w.sum(), strict=True)]))
    at = F.pmod(F.col(position) + F.col("x.k"), 2 * F.col(size))
    source = F.when(at < F.col(size), at).otherwise(2 * F.col(size) - 1 - at)
    asks = series.select(by, position, size, asked.alias("x")).select(by, F.col(position).alias("_to"), source.alias(position), F.col("x.w").alias("_w"))
    return asks.join(series.select(by, position, value), [by, position]).groupBy(by, "_to").agg(F.sum(F.col("_w") * F.col(value)).alias("v")).withColumnRenamed("_to", position)


def distinct_items(items: DataFrame, key: str, vector: str) -> DataFrame:
    """Items with equal vectors as one, that of the smallest key."""
    rest = [c for c in items.columns if c != vector]
    return items.groupBy(vector).agg(F.min(F.struct(key, *[c for c in rest if c != key])).alias("_r")).select(*[F.col("_r")[c].alias(c) for c in rest], vector)


def between_class(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, score): w0 * w1 * (m0 - m1) ** 2 of the values below and from the group's mean on."""
    cut = df.groupBy(by).agg(F.avg(value).alias("_t"))
    low = F.col(value) < F.col("_t")
    x = df.join(cut, by).groupBy(by).agg(F.count_if(low).alias("n0"), F.count_if(~low).alias("n1"), F.avg(F.when(low, F.col(value))).alias("m0"), F.avg(F.when(~low, F.col(value))).alias("m1"))
    n = F.col("n0") + F.col("n1")
    return x.select(by, (F.col("n0") * F.col("n1") / n / n * (F.col("m0") - F.col("m1")) ** 2).alias("score"))


def floor_raster(spans: DataFrame, sizes: DataFrame, rate: float, key: str = "gid") -> DataFrame:
    """(key, frame, y) of the floor of duration * rate frames of each key of ``sizes`` (key, duration), one at least: 1 if the frame's time lies in a half-open span clipped to the duration. A key of a null duration has one frame.

    Spans become ranges of frames, so nothing is compared pair by pair; a span's work is its frames.
    """
    end = F.col("duration")
    every = sizes.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor(end * rate), F.lit(1)) - 1)).alias("frame"))
    hit = clipped(spans, sizes, key).select(key, F.explode(F.filter(F.sequence(F.greatest(F.floor(F.col("start") * rate) - 1, F.lit(0)), F.ceil(F.col("end") * rate)), lambda f: (f / F.lit(float(rate)) >= F.col("start")) & (f / F.lit(float(rate)) < F.col("end")))).alias("frame"))
    return every.join(hit.distinct().withColumn("_hit", F.lit(1)), [key, "frame"], "left").select(key, "frame", F.coalesce("_hit", F.lit(0)).alias("y"))


def clipped(spans: DataFrame, sizes: DataFrame, key: str = "gid") -> DataFrame:
    """Spans inside [0, duration) of their key; what is empty then is left out, as are keys without a duration."""
    inside = spans.join(sizes.select(key, "duration"), key).withColumns({"start": F.greatest(F.col("start"), F.lit(0.0)), "end": F.least("end", "duration")})
    return inside.where("end > start and duration is not null").drop("duration")

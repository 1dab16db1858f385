"""Column functions: time windows, probabilities, intervals, vectors, maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``. Columns that a lambda reads would otherwise be evaluated for every element, or be taken for a new column of that name in the same select."""
    return F.transform(F.array(value), body)[0]


def n_frames(duration: Column, rate: float) -> Column:
    """Frames of a curve: ceil with a tolerance, at least one."""
    return F.greatest(F.ceil(duration * rate - 1e-9).cast("long"), F.lit(1).cast("long"))


def fixed_windows(duration: Column, seconds: float) -> Column:
    """array<struct<start, end>> of windows of fixed length, the last one cut at the duration."""
    n = F.greatest(F.ceil(duration / seconds - 1e-9).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * seconds).alias("start"), F.least((i + 1) * seconds, duration).alias("end")))


def equal_segments(duration: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * duration / n).alias("start"), ((i + 1) * duration / n).alias("end")))


def clips(duration: Column, length: float, stride: float) -> Column:
    """Clips around centres every ``stride`` before the duration, each cut at both ends of it: (centre, start, end)."""
    n = F.greatest(F.ceil((duration - 1e-9) / stride).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * stride).alias("centre"), F.greatest(i * stride - length / 2, F.lit(0.0)).alias("start"), F.least(i * stride + length / 2, duration).alias("end")))


def sparse_indices(n: Column, k: int) -> Column:
    """Up to k of n positions, by rounding half to even on an even spacing; all if there are no more than k."""
    spaced = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (n - 1) / (k - 1)).cast("long")))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(n <= k, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(spaced)


def neighbourhood(centre: Column, n: Column, half: int) -> Column:
    """Positions around a centre, clipped to [0, n)."""
    return F.sequence(F.greatest(centre - half, F.lit(0)), F.least(centre + half, n - 1))


def slot_of(t: Column, duration: Column, n: int) -> Column:
    """Which of n equal parts of the duration a time is in; 0 without a duration."""
    return F.when(duration > 0, F.least(F.greatest(F.floor(t / duration * n), F.lit(0)), F.lit(n - 1))).otherwise(0).cast("int")


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column, least: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))
    return F.log(q / (1 - q))


def entropy(p: Column, least: float = 1e-12) -> Column:
    """Binary entropy in nats."""
    q = F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))
    return -(q * F.log(q) + (1 - q) * F.log(1 - q))


def inverse_entropy(h: Column, steps: int = 60) -> Column:
    """The p in [1/2, 1) with the given binary entropy, by bisection."""
    def halved(a, _):
        mid = (a["lo"] + a["hi"]) / 2
        high = entropy(mid) > h
        return F.struct(F.when(high, mid).otherwise(a["lo"]).alias("lo"), F.when(high, a["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.5).alias("lo"), F.lit(1 - 1e-12).alias("hi")), halved, lambda a: (a["lo"] + a["hi"]) / 2)


def wilson(k: Column, n: Column, z: float = 1.959964) -> Column:
    """Struct (low, high) of the Wilson interval; null for n = 0."""
    p, d = k / n, 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    centre = (p + z * z / (2 * n)) / d
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high")))


def noisy_or(ps: Column) -> Column:
    return 1 - F.aggregate(ps, F.lit(1.0), lambda a, p: a * (1 - F.coalesce(p, F.lit(0.0))))


def top_mean(xs: Column, k: int) -> Column:
    """Mean of the k largest; 0 without any."""
    top = F.slice(F.sort_array(F.filter(xs, lambda x: x.isNotNull()), asc=False), 1, k)
    return F.when(F.size(top) > 0, F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)).otherwise(0.0)


def log_sum_exp(xs: Column) -> Column:
    """Null entries are left out; null if none are left."""
    of = lambda own, top: top + F.log(F.aggregate(own, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return let(F.filter(xs, lambda x: x.isNotNull()), lambda own: let(F.array_max(own), lambda top: F.when(top.isNotNull(), of(own, top))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def fixed_length(xs: Column, length: int) -> Column:
    """Bucket means down to ``length``, or zeros appended up to it."""
    n = F.size(xs)
    mean = lambda i: F.aggregate(F.slice(xs, (F.floor(i * n / length) + 1).cast("int"), (F.floor((i + 1) * n / length) - F.floor(i * n / length)).cast("int")), F.lit(0.0), lambda a, x: a + x) / (F.floor((i + 1) * n / length) - F.floor(i * n / length))
    return F.when(n <= length, F.concat(xs, F.array_repeat(F.lit(0.0), F.greatest(length - n, F.lit(0))))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), mean))


def bayes_update(prior: Column, judged: Column, reliability: float, edge: float = 1e-9) -> Column:
    """Posterior after a binary judgement, of a prior kept ``edge`` away from 0 and 1; a null judgement changes nothing."""
    p = F.least(F.greatest(prior, F.lit(edge)), F.lit(1 - edge))
    like1, like0 = F.when(judged == 1, reliability).otherwise(1 - reliability), F.when(judged == 1, 1 - reliability).otherwise(reliability)
    return F.when(judged.isNull(), prior).otherwise(p * like1 / (p * like1 + (1 - p) * like0))


def box_iou(a: Column, b: Column) -> Column:
    """Of structs (x0, y0, x1, y1)."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda x: (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def tiles(box: Column, least: int = 4) -> Column:
    """Four parts of a box of whole pixels: side by side along a side twice as long as the other, else two by two. The last part of a side takes its remainder; none if a side has under ``least`` pixels."""
    w, h = box["x1"] - box["x0"], box["y1"] - box["y0"]
    nx, ny = (F.when(w >= 2 * h, long).when(h >= 2 * w, short).otherwise(2) for long, short in ((4, 1), (1, 4)))
    edge = lambda low, high, size, n, k: F.when(k == n, high).otherwise(low + k * F.floor(size / n))

    def part(k):
        i, j = k % nx, F.floor(k / nx)
        return F.struct(*[edge(*side, at).cast("long").alias(c) for c, side, at in (("x0", (box["x0"], box["x1"], w, nx), i), ("y0", (box["y0"], box["y1"], h, ny), j), ("x1", (box["x0"], box["x1"], w, nx), i + 1), ("y1", (box["y0"], box["y1"], h, ny), j + 1))])

    return F.when(F.least(w, h) >= least, F.transform(F.sequence(F.lit(0), F.lit(3)), part)).otherwise(F.array())


def to_pixels(parent: Column, part: Column, scale: int = 1000) -> Column:
    """A box in whole parts of ``scale`` of its parent, in whole pixels: low ends rounded down, high ends up."""
    w, h = parent["x1"] - parent["x0"], parent["y1"] - parent["y0"]
    ends = (("x0", parent["x0"] + F.floor(part["x0"] * w / scale)), ("y0", parent["y0"] + F.floor(part["y0"] * h / scale)), ("x1", parent["x0"] + F.ceil(part["x1"] * w / scale)), ("y1", parent["y0"] + F.ceil(part["y1"] * h / scale)))
    return F.struct(*[e.cast("long").alias(c) for c, e in ends])


def any_of(*columns: Column) -> Column:
    return reduce(lambda a, b: a | b, columns)


def any_dim(label: Column, first: int, last: int) -> Column:
    """Whether one of the dimensions from ``first`` to ``last`` (from 0, both included) of a label list is set; false for a null or shorter list."""
    return F.coalesce(F.exists(F.slice(label, first + 1, last - first + 1), lambda x: F.coalesce(x == 1, F.lit(False))), F.lit(False))


def only_first(label: Column) -> Column:
    """Whether dimension 0 is set and no other."""
    return any_dim(label, 0, 0) & ~any_dim(label, 1, 2**20)


def filled_end(start: Column, end: Column, following: Column, duration: Column, last_resort: float = 30.0) -> Column:
    """A missing end: the start that follows, else the duration, else ``last_resort`` after the start. Null if that isn't after the start."""
    filled = F.coalesce(end, following, duration, start + last_resort)
    return F.when(filled > start, filled)


def widened_end(start: Column, end: Column, seconds: float = 1.0) -> Column:
    """The end, or ``seconds`` after the start if the end isn't after it; null if either is missing or not finite."""
    finite = ~F.isnan(start) & ~F.isnan(end) & (F.abs(start) < float("inf")) & (F.abs(end) < float("inf"))
    return F.when(finite, F.when(end <= start, start + seconds).otherwise(end))


def nonincreasing(p: Column) -> Column:
    """The nearest non-increasing list in least squares: at k the least over i <= k of the largest mean of p[i..j], j >= k. For short lists; its work is their cube."""
    n = F.size(p)
    to = F.transform(F.sequence(F.lit(0), n), lambda k: F.aggregate(F.slice(p, F.lit(1), k), F.lit(0.0), lambda a, x: a + x))
    mean = lambda i, j: (F.element_at(to, j + 1) - F.element_at(to, i)) / (j - i + 1)
    largest = lambda i, k: F.array_max(F.transform(F.sequence(k, n), lambda j: mean(i, j)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.array_min(F.transform(F.sequence(F.lit(1), k), lambda i: largest(i, k))))).otherwise(p)

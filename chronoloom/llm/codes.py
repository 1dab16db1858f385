"""Vector codes: product quantisation trained by Lloyd's rounds under Elkan's bounds, exact in whole numbers.

A component x becomes the integer floor(scale * x). Vectors are cut into ``parts``
equal parts, and each part position has a codebook of ``entries`` entries, which
start as that part of the vectors with the smallest keys. For each part a vector
keeps an upper bound of the distance to its entry, and one lower bound for every
entry. In a round the bounds move by as much as the entries have moved. An entry
is passed over if its lower bound, or half its distance to the part's own entry,
is above the upper bound; a part all of whose entries are passed over stays as it
is. What is left is measured in whole numbers. Pruning is strict, so an equally
near entry of a smaller number is always measured, and it wins the tie.

The bounds travel with the vectors, in a table of the shared folder that each
round writes anew; the one before is deleted. A lower bound takes half a byte: it
is written as the number of steps (an eighth of the upper bound) that it is above
the upper bound, rounded down, 15 at most. No distance to another entry is below
that to the part's own entry, so no bound is lost but for its fraction of a step.
Sums of entries are aggregated by Spark before they shuffle; ``parts * entries``
rows reach the driver. Only the codebooks and their movements go to the tasks.

Rows with a null vector or with a null or non-finite component are left out. All
vectors need one number of components, a multiple of ``parts``: that which most
of the rows have, the larger one of a tie; rows with another number are left out.
Rows repeated with their key count each, and of those the smaller vector comes
first; rows without a key come after all others. With fewer rows than ``entries``
there are fewer entries, with none the result is empty. An entry whose parts have
all gone stays where it is. A component of 2 ** 27 or more in size stops the
query, as squared distances might not fit a long. Columns other than key, vector
and label aren't read, whatever their names.

``label_error`` is summed before it is joined to the rows. Up to
``broadcast_labels`` labels go to every task; more of them are joined, the rows
of a label dealt over ``SALTS`` tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.clustering import SLACK, down, exact, finite, matrix, squared, squared_each, up, whole
from chronoloom.llm.shared import drop, fresh_path, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BROADCAST_LABELS, SALTS = 100_000, 16

#: Steps of a lower bound within one upper bound, and the largest number of them that half a byte holds.
STEPS, MOST = 8, 15
#: Distances that are measured at once.
PAIRS = 1 << 18


def pack(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Lower bounds, none below the row's upper bound, as half bytes."""
    step = np.maximum(upper, 1.0) / STEPS
    n = np.clip(np.floor((lower - upper[:, None]) / step[:, None]), 0, MOST).astype(np.uint8)
    if n.shape[1] % 2:
        n = np.pad(n, ((0, 0), (0, 1)))
    return n[:, ::2] << 4 | n[:, 1::2]


def unpack(packed: np.ndarray, upper: np.ndarray, entries: int) -> np.ndarray:
    """Lower bounds that ``pack`` wrote, rounded down."""
    n = np.empty((len(packed), 2 * packed.shape[1]), dtype=np.float32)
    n[:, ::2], n[:, 1::2] = packed >> 4, packed & 15
    step = np.maximum(upper, 1.0) / STEPS
    return (n[:, :entries] * (step * (1 - 1e-5))[:, None] + (upper * (1 - 1e-5))[:, None]).astype(np.float32)


class Codebook:
    """One part position: its entries, their movement in the round before, and half the distances between them."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        self.moved = np.zeros(len(entries)) if before is None else up(squared_each(*exact(entries, before)))
        apart = down(np.maximum(squared(*exact(entries, entries)), 0))
        np.fill_diagonal(apart, np.inf)
        self.apart, self.alone = apart.astype(np.float32) * np.float32(1 - 1e-6), apart.min(1, initial=np.inf) / 2

    def start(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entries, upper and lower bounds of parts that have no bounds yet."""
        d = squared(*exact(x, self.entries))
        own = d.argmin(1)
        return own, up(d[np.arange(len(d)), own]), down(d)

    def round(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest entries, bounds, and how many distances were measured. ``lower`` is what the round before left."""
        x, c = exact(x, self.entries)
        upper, taken = (upper + self.moved[own]) * (1 + SLACK), 0
        lower = lower * np.float32(1 - 1e-6) - self.moved.astype(np.float32) * np.float32(1 + 1e-6)
        own = own.copy()
        rows = np.flatnonzero(~(upper < self.alone[own]))
        best = squared_each(x[rows], c[own[rows]])
        taken += len(rows)
        upper[rows] = up(best)
        most = upper[rows].astype(np.float32) * np.float32(1 + 1e-6)
        left = (lower[rows] <= most[:, None]) & (self.apart[own[rows]] <= 2 * most[:, None])
        line, entry = np.nonzero(left)  # by rows, then by entries
        taken += len(line)
        d = np.concatenate([squared_each(x[rows[line[k : k + PAIRS]]], c[entry[k : k + PAIRS]]) for k in range(0, len(line), PAIRS)] or [best[:0]])
        lower[rows[line], entry] = down(d)
        lower[rows, own[rows]] = down(best)  # the own entry's bound, should it be left
        if len(line):
            at = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            least = np.minimum.reduceat(d, at)
            hit = np.flatnonzero(d == np.repeat(least, np.diff(np.append(at, len(line)))))
            hit = hit[np.concatenate([[True], line[hit][1:] != line[hit][:-1]])]  # the smallest number among equals
            own_best, r = best[line[hit]], rows[line[hit]]
            better = (d[hit] < own_best) | ((d[hit] == own_best) & (entry[hit] < own[r]))
            own[r[better]], upper[r[better]] = entry[hit][better], up(d[hit][better])
        # what is far from the own entry is far from the part
        lower = np.maximum(lower, self.apart[own] - upper[:, None].astype(np.float32) * np.float32(1 + 1e-6))
        return own, upper, lower, taken


def _bytes(values: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values of one length."""
    n, width = values.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def _round(books: list[Codebook], first: bool, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts, (entries, width) = len(books), books[0].entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for k in range(0, whole_batch.num_rows, 2_000):  # the lower bounds of so many rows at once
                batch = whole_batch.slice(k, 2_000)
                n = batch.num_rows
                x = matrix(batch.column("v"), parts * width).reshape(n, parts, width)
                if not first:
                    code, above = matrix(batch.column("code"), parts), matrix(batch.column("upper"), parts, np.float64)
                    packed = np.frombuffer(b"".join(batch.column("lower").to_pylist()), dtype=np.uint8).reshape(n, parts, -1)
                owns, uppers, lowers, error = [], [], [], np.zeros(n, np.int64)
                for p, book in enumerate(books):
                    if first:
                        own, upper, lower = book.start(x[:, p])
                    else:
                        own, upper, lower, _ = book.round(x[:, p], code[:, p], above[:, p], unpack(packed[:, p], above[:, p], entries))
                    owns.append(own)
                    if last:
                        a, c = exact(x[:, p], book.entries)
                        error += squared_each(a, c[own]).astype(np.int64)
                    else:
                        uppers.append(upper)
                        lowers.append(pack(lower, upper))
                held = [batch.column(0), batch.column(1)]
                if last:
                    codes = [bytes(r).hex() for r in np.stack(owns, 1).astype(np.uint8)]
                    yield pa.RecordBatch.from_arrays([*held, pa.array(codes, pa.string()), pa.array(error)], ["key", "label", "code", "error"])
                else:
                    yield pa.RecordBatch.from_arrays([*held, batch.column("v"), _lists(np.stack(owns, 1), pa.int32()), _lists(np.stack(uppers, 1), pa.float64()), _bytes(np.concatenate(lowers, 1))], ["key", "label", "v", "code", "upper", "lower"])

    return run


def _packed(df: DataFrame, name: str) -> DataFrame:
    """As ``stored``, with a codec that makes use of the bounds' few distinct values."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_path = path
    return back


def _updated(table: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """Codebooks whose entries are the floors of their parts' means."""
    width = books[0].entries.shape[1]
    pieces = F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.struct(p.alias("part"), F.get("code", p).alias("entry"), F.slice("v", p * width + 1, F.lit(width)).alias("v")))
    sums = table.select(F.explode(pieces).alias("s")).select("s.*").groupBy("part", "entry").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("v", F.lit(i)).cast("long")) for i in range(width)]).alias("total"))
    new = [b.entries.copy() for b in books]
    for r in sums.collect():  # an entry of a part is a row
        new[r["part"]][r["entry"]] = [s // r["n"] for s in r["total"]]
    return [Codebook(n, b.entries) for n, b in zip(new, books, strict=True)]


def encoded(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Rows (key, label, code, error) of all vectors that count, and the codebooks by part, entry and component."""
    if entries > 256:
        raise ValueError("an entry's number has to fit two hexadecimal digits")
    held = vectors.where(finite(F.col(vector))).select(F.col(key).alias("key"), F.col(label).alias("label"), whole(F.col(vector), scale).alias("v"), F.size(vector).alias("size"))
    every = stored(held, "code-vectors")
    sizes = every.where((F.col("size") > 0) & (F.col("size") % parts == 0)).groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    kinds = {c: every.schema[c].dataType.simpleString() for c in ("key", "label")}
    if not sizes:
        return vectors.sparkSession.createDataFrame([], f"key {kinds['key']}, label {kinds['label']}, code string, error bigint"), np.zeros((parts, 0, 0), np.int64)
    table = every.where(F.col("size") == sizes[0]["size"]).drop("size")
    start = np.array([r["v"] for r in table.orderBy(F.col("key").asc_nulls_last(), "v").select("v").limit(entries).collect()], dtype=np.int64)
    start = start.reshape(len(start), parts, -1)
    books, before = [Codebook(start[:, p]) for p in range(parts)], every
    schema = f"key {kinds['key']}, label {kinds['label']}, v array<int>, code array<int>, upper array<double>, lower binary"
    for k in range(rounds):
        table = _packed(table.mapInArrow(_round(books, k == 0, False), schema), "code-round")
        drop(before)
        before, books = table, _updated(table, books)
    last = stored(table.mapInArrow(_round(books, rounds == 0, True), f"key {kinds['key']}, label {kinds['label']}, code string, error bigint"), "codes")
    drop(before)
    return last, np.stack([b.entries for b in books])


def label_errors(rows: DataFrame, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """``rows`` with the error summed over equal labels; null labels are equal."""
    sums = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    if sums.limit(broadcast_labels + 1).count() <= broadcast_labels:
        return rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key", "code"), F.lit(SALTS)))
    copies = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt"))).drop("of", "salt", "of_salt")


def report(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: key, code, error, label_error, codebooks_sha256."""
    rows, books = encoded(vectors, key, vector, label)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return label_errors(rows).select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern. Each piece is merged on its own: a
segment tree over the byte positions holds, for each live position, the rank of
the pair that starts there together with the position, so its root is the
leftmost pair of the least rank. A merge changes the pairs at the merged
position and its left neighbour and clears the swallowed position, which are
three point updates of logarithmic cost, so a piece of n bytes takes O(n log n).
Every piece that isn't a token itself goes through the tree, whatever its length;
pieces of up to ``LONGEST`` bytes do so many at a time, as rows of numpy matrices.

Null text encodes as the empty text: no ids, empty bytes. Very long texts are
encoded whole. Repeated rows are encoded like any other. Only the text column is
read; of columns with the names of results, ``with_tokens`` replaces ``ids``.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pieces remembered by one Python worker; the memory of a worker stays bounded.
CACHE_PIECES = 300_000
#: Longer pieces are rarely seen again and are not remembered.
CACHE_PIECE_CHARS = 64

#: A node of the tree is rank * 2 ** 32 + position; this one stands for no pair.
NONE = 1 << 62
POSITION = (1 << 32) - 1
#: Pieces of up to so many bytes are merged side by side, so many at once; those of so many characters of text are looked up together.
LONGEST, ROWS, TOGETHER_CHARS = 64, 20_000, 2_000_000
#: Code points below this are Latin letters, digits and signs.
LATIN = 0x250


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: one base64 token and its rank a line. Runs on the driver; the size is the vocabulary's."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n, get = len(piece), ranks.get
    width = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        if (rank := get(piece[i : i + 2])) is not None:
            tree[width + i] = rank << 32 | i
    for node in range(width - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    after = list(range(1, n + 1))  # where the token at a live position ends
    before = list(range(-1, n - 1))  # the live position on its left

    while (least := tree[1]) != NONE:
        i = least & POSITION
        gone = after[i]
        end = after[i] = after[gone]
        left = before[i]
        tree[width + gone] = tree[width + i] = NONE
        if end < n:
            before[end] = i
            if (rank := get(piece[i : after[end]])) is not None:
                tree[width + i] = rank << 32 | i
        if left >= 0:
            rank = get(piece[left:end])
            tree[width + left] = NONE if rank is None else rank << 32 | left
        for at in (i, gone, left) if left >= 0 else (i, gone):  # up to the root, or to a node that stays as it is
            node = (width + at) >> 1
            while node:
                value, other = tree[2 * node], tree[2 * node + 1]
                if other < value:
                    value = other
                if tree[node] == value:
                    break
                tree[node] = value
                node >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Merger:
    """Merges many pieces at once. Pieces of one tree width are rows of a matrix, a row holds one piece's tree, and each step makes the next merge of every row."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        get = ranks.get
        pairs = sorted((a << 32 | b, rank) for token, rank in ranks.items() for k in range(1, len(token)) if (a := get(token[:k])) is not None and (b := get(token[k:])) is not None)
        self.pairs, self.merged = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(1, np.int64), np.full(1, -1, np.int64))

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tree leaves of the pairs of tokens at positions; -1 is no token."""
        key = left.astype(np.int64) << 32 | right
        place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        known = (self.pairs[place] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.merged[place] << 32 | at, NONE)

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        m, rows = len(pieces), np.arange(len(pieces))
        n = np.fromiter(map(len, pieces), dtype=np.int64, count=m)
        token = np.full((m, width + 1), -1, dtype=np.int32)
        inside = np.arange(width + 1) < n[:, None]
        token[inside] = self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        after, before = np.tile(np.arange(1, width + 2), (m, 1)), np.tile(np.arange(-1, width), (m, 1))
        tree = np.full((m, 2 * width), NONE, dtype=np.int64)
        tree[:, width:] = self.leaves(token[:, :-1], token[:, 1:], np.arange(width))
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        while True:
            least = tree[rows, 1]
            live = least != NONE
            rows, least = rows[live], least[live]
            if not len(rows):
                break
            i = least & POSITION
            gone = after[rows, i]
            end = after[rows, gone]
            left = before[rows, i]
            token[rows, i], token[rows, gone] = least >> 32, -1
            after[rows, i], before[rows, end] = end, i
            tree[rows, width + gone] = NONE
            tree[rows, width + i] = self.leaves(token[rows, i], token[rows, end], i)
            some = left >= 0
            tree[rows[some], width + left[some]] = self.leaves(token[rows[some], left[some]], token[rows[some], i[some]], left[some])
            for at in (gone, i, np.where(some, left, i)):
                node = (width + at) >> 1
                for _ in range(width.bit_length() - 1):
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node >>= 1
        kept = token >= 0
        flat, ends = token[kept], np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).tolist()
        return [flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]

    def ids(self, pieces: list[str]) -> list[bytes]:
        """Packed token ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        raw = [p.encode() for p in pieces]
        for k, r in enumerate(raw):
            if (whole := self.ranks.get(r)) is not None:
                out[k] = whole.to_bytes(4, sys.byteorder)
            elif len(r) > LONGEST:
                out[k] = np.array(merge(r, self.ranks), dtype=np.int32).tobytes()
            else:
                by_width.setdefault(1 << (len(r) - 1).bit_length(), []).append(k)
        for width, own in by_width.items():
            for a in range(0, len(own), ROWS):
                some = own[a : a + ROWS]
                for k, packed in zip(some, self._matrix([raw[k] for k in some], width), strict=True):
                    out[k] = packed
        return out


def splitter(pattern: str):
    """A function from text to its pieces. Texts of Latin letters go through the standard library's engine, with the pattern's classes spelled out; all others through the engine that knows the classes."""
    find = regex.compile(pattern).findall
    chars = [chr(c) for c in range(LATIN)]
    of = lambda cls: "".join(f"\\x{ord(c):02x}" if ord(c) < 256 else c for c in chars if regex.match(cls, c))
    letters, numbers, spaces = of(r"\p{L}"), of(r"\p{N}"), of(r"\s")
    inside = re.sub(r"\[\^[^\]]*\]", lambda m: m[0].replace(r"\s", spaces).replace(r"\p{L}", letters).replace(r"\p{N}", numbers), pattern)
    spelled = inside.replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    quick, other = re.compile(spelled).findall, re.compile(f"[^\\x00-{chars[-1]}]").search
    return lambda text: find(text) if other(text) else quick(text)


#: Pieces met by this Python worker and its merger, by rank file and pattern.
_known: dict[tuple[str, str], tuple[dict[str, bytes], Merger]] = {}


def encoder(spark: SparkSession, path: str, pattern: str):
    """A column function: text to array<int> of token ids."""
    ranks_everywhere = spark.sparkContext.broadcast(load_ranks(path))

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = splitter(pattern)
        if (path, pattern) not in _known:
            _known[path, pattern] = {}, Merger(ranks_everywhere.value)
        known, merger = _known[path, pattern]

        def coded(texts: list[str]) -> list[bytes]:
            split = [pieces(t) for t in texts]
            new = {p for own in split for p in own if p not in known}
            if len(known) + len(new) > CACHE_PIECES:
                known.clear()
                new = {p for own in split for p in own}
            known.update(zip(new, merger.ids(list(new)), strict=True))
            out = [b"".join([known[p] for p in own]) for own in split]
            for p in new:
                if len(p) > CACHE_PIECE_CHARS:
                    del known[p]
            return out

        for texts in batches:
            parts, waiting, chars = [], [], 0
            for text in texts:
                waiting.append(text.as_py() or "")
                chars += len(waiting[-1])
                if chars > TOGETHER_CHARS:
                    parts += coded(waiting)
                    waiting, chars = [], 0
            parts += coded(waiting)
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))

    return F.arrow_udf(encode, "array<int>")


def decoder(spark: SparkSession, path: str):
    """A column function: array<int> of token ids to the bytes they stand for."""
    tokens_everywhere = spark.sparkContext.broadcast({rank: token for token, rank in load_ranks(path).items()})

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = tokens_everywhere.value.__getitem__
        for rows in batches:
            flat, ends = rows.values.to_numpy(), rows.offsets.to_pylist()
            yield pa.array([b"".join(map(token, flat[a:b].tolist())) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())

    return decode


def with_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` in the column ``ids``."""
    return docs.withColumn(ids, encoder(docs.sparkSession, path, pattern)(F.col(text)))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode and digest: key, n_tokens, ids_sha256, decoded_sha256."""
    coded = with_tokens(docs.select(key, text), path, pattern, text).select(key, "ids")
    back = coded.withColumn("decoded", decoder(docs.sparkSession, path)(F.col("ids")))
    return back.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )

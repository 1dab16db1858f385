"""Substring duplicates by content-defined chunking with a gear rolling hash.

A text is a sequence of words. The gear hash of a boundary between words is the
shifted sum of random numbers, one for each of the last ``HASHED_WORDS`` words. A
boundary is a cut if its hash is the least of ``REACH`` neighbouring ones, so
chunks between cuts have 1 to ``REACH`` words. A cut depends on the words near it
alone: an insertion moves the cuts around it and no others.

A chunk of a few words says little, so its digest covers the ``LEAD`` words
before it as well. Chunks are deduplicated by digest. An equal digest by itself
is a run of ``LEAD + 1`` to ``LEAD + REACH`` equal words (43 to 47), so no run
under 43 words is ever reported, whatever stands next to it. A run of ``LEAD + 2
* REACH - 1`` words (51) or more is always found: its boundaries from ``LEAD`` to
``LEAD + REACH - 1`` hold a common cut, and the next cut, at most ``REACH``
further, lies inside the run and is the same in both texts. Both hold for words
of any length; digests have 64 bits.

A first pass counts in how many texts a digest stands, and the smallest key that
has it; it aggregates before it shuffles. A second pass sends the places of all
chunks to these counts and keeps those that occur again. A span is a stretch of
overlapping chunks of one text that all have the same first holder, so every
chunk of it stands in that one text; spans with different first holders may
overlap. Only spans whose first holder is another text are cut out by
``without_repeats``: each word cut stands, inside the same chunk, in a text with
a smaller key, so following the keys down, one copy of every word stays.

Null and empty texts have no spans, nor have texts of ``LEAD`` words or fewer.
Words compare with their case, whitespace between them doesn't count. A passage
that a single text repeats is no repeat. Texts are told apart by key and a
64-bit hash of the text, under the first seed for which no two unlike texts of a key
share a hash; that is looked up in all rows before anything else. Rows repeated with their key count as texts that share everything;
all of them carry the smallest key and so are first. Rows without a key are
never the first holder of what a row with a key has; what only they hold stays
in all of them. Very long texts are read whole, in memory of a few dozen bytes a
word. Columns other than key and text are carried along untouched, whatever
their names; ``hash`` in the result of ``repeats`` is that of the text. Offsets
are code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.shared import arrow_function, stored, unused

#: Words under the gear hash, boundaries of which one is a cut, words before a chunk that its digest covers too.
HASHED_WORDS, REACH, LEAD = 4, 5, 42

GEAR = np.random.default_rng(2026).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, *range(9, 14)]] = True

#: An odd number and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

#: Offsets and word numbers travel as the halves of one number each.
CHUNK = "struct<digest:bigint,place:bigint,words:bigint>"
SPAN = "struct<start:int,end:int,n_words:bigint,n_texts:bigint>"
SPAN_ARROW = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int64()), ("n_texts", pa.int64())])


def gear(tokens: np.ndarray) -> np.ndarray:
    """Gear hash after each word: the sum over k < HASHED_WORDS of GEAR[word k places back] << k, found by doubling."""
    h = GEAR[tokens & np.uint64(0xFFFF)]
    step = 1
    while step < HASHED_WORDS:
        moved = np.zeros_like(h)
        moved[step:] = h[:-step] << np.uint32(step)
        h = h + moved
        step *= 2
    return h


def cuts(hashes: np.ndarray) -> np.ndarray:
    """Positions that are the least, the first of equals, in any window of REACH positions."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    ranked = hashes.astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    least = np.lib.stride_tricks.sliding_window_view(ranked, min(REACH, n)).min(axis=1)
    # the least of a window never moves back
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n modulo 2 ** 64."""
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_short = 1 << 12
_up, _down = powers(BASE, _short), powers(INVERSE, _short)


def digests(tokens: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """64-bit digests of the word ranges [first, past): differences of a polynomial's running sums, brought to a common power."""
    n = len(tokens)
    up, down = (_up[: n + 1], _down[: n + 1]) if n <= _short else (powers(BASE, n), powers(INVERSE, n))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * up[:n], dtype=np.uint64)])
    return ((total[past] - total[first]) * down[first]).view(np.int64)


def chunks(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of a text, each with its lead: digest, number of the first word, number past the last word."""
    own = (text or "").encode().split()
    n = len(own)
    if n <= LEAD:
        none = np.zeros(0, np.int64)
        return none, none, none
    tokens = np.fromiter(map(xxhash.xxh3_64_intdigest, own), dtype=np.uint64, count=n)
    at = cuts(gear(tokens)) + 1  # the hash after word k is that of the boundary before word k + 1
    bound = np.concatenate([[LEAD], at[(at > LEAD) & (at < n)], [n]])  # a text's first lead ends a chunk, its end does too
    first, past = bound[:-1] - LEAD, bound[1:]
    return digests(tokens, first, past), first, past


def _lists(parts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    return pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), np.concatenate(parts) if parts else np.zeros(0, np.int64)


@arrow_function("array<bigint>")
def distinct_digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Distinct digests of a text's chunks."""
    for texts in batches:
        ends, flat = _lists([np.unique(chunks(t.as_py())[0]) for t in texts])
        yield pa.ListArray.from_arrays(ends, pa.array(flat))


@arrow_function(f"array<{CHUNK}>")
def placed_digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Chunks with digest, code point offsets (start, end) and words (first, number)."""
    for texts in batches:
        held, places, numbers = [], [], []
        for t in texts:
            text = t.as_py()
            digest, first, past = chunks(text)
            held.append(digest)
            if not len(digest):
                continue
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            space = SPACES[raw]
            begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))[first]
            end = np.flatnonzero(~space & np.concatenate([space[1:], [True]]))[past - 1] + 1
            if len(raw) != len(text):
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                begin, end = chars[begin], chars[end]
            places.append(begin.astype(np.int64) << 32 | end)
            numbers.append(first.astype(np.int64) << 32 | (past - first))
        ends, flat = _lists(held)
        rows = pa.StructArray.from_arrays([pa.array(flat), pa.array(_lists(places)[1]), pa.array(_lists(numbers)[1])], ["digest", "place", "words"])
        yield pa.ListArray.from_arrays(ends, rows)


@arrow_function(f"array<{SPAN}>")
def united(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Spans of sorted chunks; one ends where the next chunk begins past it."""
    for rows in batches:
        flat, sizes = rows.flatten(), np.diff(rows.offsets.to_numpy())
        first, past, start, end, n_texts = (flat.field(k).to_numpy() for k in range(5))
        if not len(first):
            yield pa.array([[]] * len(rows), pa.list_(SPAN_ARROW))
            continue
        group = np.repeat(np.arange(len(sizes)), sizes)
        # chunks are sorted by their first words and so, in a text, by their last ones
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (first[1:] > past[:-1])])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(first)) - 1
        ends = np.concatenate([[0], np.cumsum(np.bincount(group[at], minlength=len(sizes)))])
        columns = [start[at], end[last], (past[last] - first[at]).astype(np.int64), np.maximum.reduceat(n_texts, at)]
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SPAN_ARROW, strict=True)], fields=list(SPAN_ARROW)))


def _high(c: str):
    return F.shiftright(c, 32).cast("int")


def _low(c: str):
    return F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def text_hash(text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), text)


def telling_seed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> int:
    """The first seed under which unlike texts of a key have unlike hashes."""
    seed = 0
    while True:
        own = docs.select(F.col(key).alias("key"), text_hash(F.col(text), seed).alias("hash"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("full"))
        if own.groupBy("key", "hash").agg(F.min("full").alias("a"), F.max("full").alias("b")).where("a < b").isEmpty():
            return seed
        seed += 1


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int | None = None) -> DataFrame:
    """Spans that stand in more than one text, one row each: key, hash, start, end, n_words, n_texts (most texts that share a chunk of it), first_id (smallest key among those that have it), first (this text has it)."""
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    seed = telling_seed(docs, key, text) if seed is None else seed
    counted = own.select("key", F.explode(distinct_digests(F.col("text"))).alias("digest")).groupBy("digest").agg(F.count("*").alias("n_texts"), F.min("key").alias("first_id")).where("n_texts > 1")
    # written, so that adaptive execution may split the join below where a passage stands in very many texts
    counted = stored(counted, "repeated-digests")
    places = own.select("key", text_hash(F.col("text"), seed).alias("hash"), F.explode(placed_digests(F.col("text"))).alias("s")).select("key", "hash", "s.*")
    shared = places.join(counted, "digest").select("key", "hash", _high("place").alias("start"), _low("place").alias("end"), _high("words").alias("first_word"), (_high("words") + _low("words")).alias("past_word"), "n_texts", "first_id")
    # one group is the chunks of one text with one first holder; the set takes repeated rows once, before the shuffle too
    place = F.struct("first_word", "past_word", "start", "end", "n_texts")
    held = shared.groupBy("key", "hash", "first_id").agg(F.collect_set(place).alias("chunks"))
    spans = held.select("key", "hash", "first_id", F.explode(united(F.array_sort("chunks"))).alias("s"))
    return spans.select(F.col("key").alias(key), "hash", "s.*", "first_id", F.col("first_id").eqNullSafe(F.col("key")).alias("first"))


@arrow_function("string")
def cut_out(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Text without the given spans, which may overlap."""
    for texts, spans in batches:
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if own:
                parts, past = [], 0
                for s in sorted(own, key=lambda s: s["start"]):
                    parts.append(text[past : max(past, s["start"])])
                    past = max(past, s["end"])
                text = "".join([*parts, text[past:]])
            out.append(text)
        yield pa.array(out, pa.string())


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each repeated span left only in the text that has it first."""
    seed = telling_seed(docs, key, text)
    later = repeats(docs, key, text, seed).where("not first")
    k, h, s = unused(docs, "key", "hash", "spans")
    per_text = later.groupBy(F.col(key).alias(k), F.col("hash").alias(h)).agg(F.collect_list(F.struct("start", "end")).alias(s))
    joined = docs.join(per_text, docs[key].eqNullSafe(per_text[k]) & (text_hash(docs[text], seed) == per_text[h]), "left")
    return joined.withColumn(text, cut_out(F.col(text), F.col(s))).select(*docs.columns)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per span, as ``repeats`` gives them: key, start, end, n_words, n_texts, first_id, first."""
    return repeats(docs, key, text).drop("hash")

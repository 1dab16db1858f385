"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and items are normalised to lower-case words, words to numbers. A window is
13 consecutive words of an item; an item of fewer words is one window. The
automaton reads a text's word numbers once. Its patterns are the short items and,
of the others, every seventh run of seven words: each window holds one of these
whole, so the automaton has at most one node a benchmark word instead of
thirteen. Where a run of seven is found, the words of the item on either side are
compared, six at most, and thirteen equal words in a row are hits. Places of a run
that have the same six words on either side are compared as one, so a phrase that
many items share, or one item repeats, costs no more than a rare one. A hit is a
range of words; the words' places in the original text are found only for texts
that have a hit.

The benchmark's words are counted first, and only this count comes to the driver
before the items do. Up to ``block_words`` of them make one automaton, about 50
bytes a word. More are dealt into blocks by a hash of id and text; the texts are
read once for each block, one after the other, and the hits are united, so a
worker never holds two automata.

Null and empty texts have no words and no hits. Null and empty items give no
pattern. Repeated items count once; an item without an id is named ``null``. Very
long texts are read whole; repeated rows get equal results. A column with the
name of ``out`` is replaced, others are left alone.
A text is contaminated if n_hit > 0 and 20 * n_hit >= n_words.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.shared import stored, unused

#: Words of a window, words of a pattern, words compared on either side of it.
WINDOW = 13
SEED = (WINDOW + 1) // 2
SIDE = WINDOW - SEED
#: Benchmark words of one automaton.
BLOCK_WORDS = 8_000_000
#: Places of a pattern that are compared at once.
_AT_ONCE = 4096
#: Odd numbers that hash the words around a place.
_MIX = np.random.default_rng(2026).integers(0, 1 << 63, WINDOW + SIDE, dtype=np.uint64) | np.uint64(1)

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_plain = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_machines: dict[str, Machine] = {}

RESULT = "struct<n_words:bigint,hits:array<struct<word:int,start:int,end:int>>,items:array<string>>"
HIT = pa.struct([("word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(HIT)), ("items", pa.list_(pa.string()))])


def words(text: str | None) -> list[bytes]:
    """Lower-case words of a text; every byte of a non-ASCII character belongs to a word."""
    return (text or "").encode().translate(_plain).split()


class Machine:
    """Automaton of the items' short patterns, and the items' word numbers to compare with."""

    def __init__(self, items: list[tuple[str, str]]):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}  # from 1; 0 is a word that no item has
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        parts, self.lengths = [np.full(SIDE, -1, np.int32)], []
        seen, at, own = [], [], SIDE  # pattern and place of each run, where the next item begins
        begins = []
        for _, text in items:
            held = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            begins.append(own)
            size = SEED if len(held) >= WINDOW else len(held)
            for k in range(0, len(held) - size + 1 if held else 0, SEED):
                run = tuple(held[k : k + size])
                pattern = self.machine.get(run, -1)
                if pattern < 0:
                    pattern = len(self.lengths)
                    self.machine.add_word(run, pattern)
                    self.lengths.append(size)
                seen.append(pattern)
                at.append(own + k)
            parts += [np.array(held, np.int32), np.full(SIDE, -1, np.int32)]
            own += len(held) + SIDE
        self.flat, self.begins = np.concatenate([*parts, np.full(WINDOW, -1, np.int32)]), np.array(begins, np.int64)
        self.whole = np.diff(np.append(self.begins, own)) - SIDE < WINDOW  # items that are one window
        self._fold(np.array(seen, np.int64), np.array(at, np.int64))
        if self.lengths:
            self.machine.make_automaton()

    def around(self, places: np.ndarray) -> np.ndarray:
        """The words of items from SIDE before each place to SIDE past its pattern."""
        return self.flat[places[:, None] + np.arange(-SIDE, WINDOW)]

    def _fold(self, pattern: np.ndarray, place: np.ndarray) -> None:
        """Places of a pattern that have equal words on either side are one, with a list of their items; so are those of items that are one window."""
        owner = np.searchsorted(self.begins, place, side="right") - 1
        whole = self.whole[owner] if len(owner) else np.zeros(0, bool)
        hashed = np.zeros(len(place), np.uint64)
        for k in range(0, len(place), 1 << 16):
            hashed[k : k + (1 << 16)] = (self.around(place[k : k + (1 << 16)]).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64)
        hashed[whole] = 0
        order = np.lexsort((place, hashed, whole, pattern))
        pattern, place, owner, whole, hashed = (x[order] for x in (pattern, place, owner, whole, hashed))
        differs = lambda x: np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
        new = differs(pattern) | differs(whole) | differs(hashed)
        group = np.cumsum(new) - 1
        first = place[np.flatnonzero(new)]
        apart = np.zeros(len(first), bool)  # groups whose hashes are equal by chance
        for k in range(0, len(place), 1 << 16):
            part = slice(k, k + (1 << 16))
            unlike = (self.around(place[part]) != self.around(first[group[part]])).any(axis=1) & ~whole[part]
            apart[group[part][unlike]] = True
        new |= apart[group] if len(group) else False
        starts = np.flatnonzero(new)
        self.places, self.alone = place[starts], whole[starts]
        self.bounds = np.searchsorted(pattern[starts], np.arange(len(self.lengths) + 1))
        fold = np.cumsum(new) - 1
        once = differs(fold) | differs(owner)  # owners ascend with the places of a fold
        self.owners = owner[once].astype(np.int32)
        self.owned = np.searchsorted(fold[once], np.arange(len(starts) + 1))

    def runs(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Ranges [first, past) of the words that stand in windows, and the numbers of their items."""
        get = self.numbers.get
        read = tuple(get(w, 0) for w in own)
        found = list(self.machine.iter(read)) if self.lengths else []
        if not found:
            return [], set()
        padded = np.concatenate([np.full(SIDE, -2, np.int32), np.array(read, np.int32), np.full(WINDOW, -2, np.int32)])
        ranges, folds = set(), set()
        for end, pattern in found:
            size = self.lengths[pattern]
            start = end + 1 - size
            around = padded[start : start + WINDOW + SIDE]  # from SIDE words before the pattern
            for k in range(self.bounds[pattern], self.bounds[pattern + 1], _AT_ONCE):
                number = np.arange(k, min(k + _AT_ONCE, self.bounds[pattern + 1]))
                alone = self.alone[number]
                if alone.any():
                    ranges.add((start, end + 1))
                    folds.update(number[alone].tolist())
                if size < SEED or alone.all():
                    continue
                number = number[~alone]
                equal = self.around(self.places[number]) == around
                left = np.cumprod(equal[:, SIDE - 1 :: -1], axis=1).sum(axis=1)
                right = np.cumprod(equal[:, SIDE + SEED :], axis=1).sum(axis=1)
                hit = left + SEED + right >= WINDOW
                ranges.update(zip((start - left[hit]).tolist(), (end + 1 + right[hit]).tolist(), strict=True))
                folds.update(number[hit].tolist())
        return sorted(ranges), {int(i) for f in folds for i in self.owners[self.owned[f] : self.owned[f + 1]]}


def scan(machine: Machine, text: str | None) -> tuple[int, list[dict], set[int]]:
    """Words of the text, its hit words with their code point offsets, the items found."""
    own = words(text)
    ranges, items = machine.runs(own) if own else ([], set())
    if not ranges:
        return len(own), [], set()
    hit = np.zeros(len(own) + 1, dtype=np.int32)
    for first, past in ranges:
        hit[first] += 1
        hit[past] -= 1
    raw = text.encode()
    wide = len(raw) != len(text)
    chars = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80) if wide else None
    at = lambda byte: int(byte if not wide else chars[byte - 1] if byte else 0)
    covered = np.cumsum(hit) > 0
    return len(own), [{"word": k, "start": at(m.start()), "end": at(m.end())} for k, m in enumerate(WORD.finditer(raw.lower())) if covered[k]], items


def scanner(items: list[tuple[str, str]], spark):
    """A column function for one block of items: text to RESULT."""
    everywhere, token = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    @F.arrow_udf(RESULT)
    def scan_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if token not in _machines:  # built once in each Python worker, after the one before is let go
            _machines.clear()
            _machines[token] = Machine(everywhere.value)
        for texts in batches:
            out = []
            for text in texts:
                n, hits, those = scan(_machines[token], text.as_py())
                out.append({"n_words": n, "hits": hits, "items": sorted({everywhere.value[k][0] for k in those})})
            yield pa.array(out, ARROW)

    return scan_all


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, out: str = "contamination") -> DataFrame:
    """``docs`` with a RESULT struct in the column ``out``."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.col(item_text).alias("words")).where("words is not null").distinct()
    n_words = items.agg(F.coalesce(F.sum(F.size(F.regexp_extract_all("words", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, math.ceil(n_words / block_words))
    more = unused(docs, "more")[0]
    for block in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("id", "words"), F.lit(n_blocks)) == block).orderBy("id", "words")
        found = scanner([(r["id"], r["words"]) for r in part.toLocalIterator()], spark)(F.col(text))
        if block:
            united = lambda field: F.array_sort(F.array_distinct(F.concat(F.col(out)[field], F.col(more)[field])))  # noqa: B023, E731
            docs = docs.withColumn(more, found).withColumn(out, F.struct(F.col(out)["n_words"].alias("n_words"), united("hits").alias("hits"), united("items").alias("items"))).drop(more)
        else:
            docs = docs.withColumn(out, found)
        if n_blocks > 1:
            docs = stored(docs, "contamination")
    return docs


def is_contaminated(found: Column) -> Column:
    n_hit = F.size(found["hits"])
    return (n_hit > 0) & (20 * n_hit >= found["n_words"])


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per text: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs.select(key, text), benchmark, text, block_words=block_words).select(key, F.col("contamination").alias("c"))
    return found.select(
        key,
        F.col("c.n_words").alias("n_words"),
        F.size("c.hits").cast("long").alias("n_hit"),
        F.size("c.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("c.items"), ","), 256).alias("items_sha256"),
        is_contaminated(F.col("c")).alias("contaminated"),
    )

"""Substring duplicates recomputed from their definition, and texts whose hashes meet."""

import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from chronoloom.llm import substring
from chronoloom.llm.queries import queries
from chronoloom.llm.shared import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def chunks_of(words):
    """Chunks with their leads as (first word, past word), by the definition: the least gear hash of any REACH neighbouring boundaries is a cut."""
    n = len(words)
    if n <= substring.LEAD:
        return []
    token = [int(substring.GEAR[xxhash.xxh3_64_intdigest(w.encode()) & 0xFFFF]) for w in words]
    gear = [sum(token[i - k] << k for k in range(min(substring.HASHED_WORDS, i + 1))) & 0xFFFFFFFF for i in range(n)]
    width = min(substring.REACH, n)
    cut = {min(range(a, a + width), key=lambda i: (gear[i], i)) + 1 for a in range(n - width + 1)}
    bounds = [substring.LEAD, *sorted(c for c in cut if substring.LEAD < c < n), n]
    return list(zip([b - substring.LEAD for b in bounds[:-1]], bounds[1:], strict=True))


def brute(rows):
    """All spans of (key, text) rows: key, start, end, n_words, n_texts, first_id."""
    places = [[m.span() for m in WORD.finditer(t or "")] for _, t in rows]
    words = [[t[a:b] for a, b in p] for (_, t), p in zip(rows, places, strict=True)]
    chunks = [{c: tuple(w[c[0] : c[1]]) for c in chunks_of(w)} for w in words]
    holders = defaultdict(set)
    for n, own in enumerate(chunks):
        for c in own.values():
            holders[c].add(n)
    out = []
    for n, own in enumerate(chunks):
        by_holder = defaultdict(list)
        for (a, b), c in sorted(own.items()):
            if len(holders[c]) > 1:
                by_holder[min(rows[k][0] for k in holders[c])].append((a, b, len(holders[c])))
        for first, run in by_holder.items():
            spans = []
            for a, b, k in run:
                if spans and a <= spans[-1][1]:
                    spans[-1][1:] = [b, max(k, spans[-1][2])]
                else:
                    spans.append([a, b, k])
            out += [(rows[n][0], places[n][a][0], places[n][b - 1][1], b - a, k, first) for a, b, k in spans]
    return sorted(out)


def test_every_span_of_the_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    expected = brute(rows)
    got = queries()["op7_substring_dedup"](spark, sf).collect()
    assert expected and sorted((r["doc_id"], r["start"], r["end"], r["n_words"], r["n_texts"], r["first_id"]) for r in got) == expected
    assert all(r["first"] == (r["first_id"] == r["doc_id"]) for r in got)


def passage_and_places():
    passage = " ".join(f"passage{k}" for k in range(60))
    return passage, [(1, f"holder {passage}"), (None, " ".join(f"a{k}" for k in range(15)) + f" {passage} end"), (None, f"other {passage} " + " ".join(f"b{k}" for k in range(15)))]


def all_words(rows):
    return {w for t in rows for w in t.split()}


def test_keyless_texts_with_equal_hashes_of_32_bits(spark):
    passage, rows = passage_and_places()
    many = spark.range(300_000).select(F.concat(F.lit("x"), "id", F.lit(f" {passage} tail")).alias("t"), "id").select(F.hash("t").alias("h"), "t").groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a < b")
    pair = many.first()
    own = [rows[0], (None, pair["a"]), (None, pair["b"])]
    left = substring.without_repeats(spark.createDataFrame(own, "doc_id bigint, text string")).collect()
    assert all_words(r["text"] for r in left) == all_words(t for _, t in own)


@pytest.mark.parametrize("weak", [0, 2])
def test_no_word_is_lost_when_hashes_meet(spark, monkeypatch, weak):
    """Hashes that say nothing under the first seeds."""
    good = substring.text_hash
    monkeypatch.setattr(substring, "text_hash", lambda text, seed: good(text, seed) if seed >= weak else F.lit(7).cast("long"))
    _, rows = passage_and_places()
    frame = spark.createDataFrame([*rows, (None, None), (None, ""), rows[1]], "doc_id bigint, text string")
    assert substring.telling_seed(frame) == weak
    left = substring.without_repeats(frame).collect()
    assert len(left) == 6 and all_words(r["text"] for r in left if r["text"]) == all_words(t for _, t in rows)
    assert len([r for r in substring.repeats(frame).collect() if r["doc_id"] is None and r["first_id"] == 1]) == 2

"""Operators against brute force, on the smallest tables and on awkward rows."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronoloom import storage
from chronoloom.llm import bpe, decontaminate, langid, licenses, pii, quality, sharding, simhash, substring, warc
from chronoloom.llm.queries import queries, tokenizer
from chronoloom.llm.shared import table

LONG = "word " * 30_000 + "tail"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, kept boolean, fp bigint, h bigint, digest string"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a"),  # a repeated row
    (2, "The quick brown fox jumps over the lazy dog again and again", None, None),  # an equal text
    (3, None, "en", "a"),
    (4, "", "fr", None),
    (5, " \t\r\n ", "fr", "b"),
    (6, LONG, "en", "b"),
    (7, "x" * 50_000, "de", "b"),
    (None, "écrivez à Jean.Dupont@exemple.co.uk ou au +33 1 23 45 67 89 ; serveur 10.0.0.1 et 300.1.1.1, carte 4111-1111-1111-1111", "fr", "c"),
    (9, "1.2.3.4.5.6.7.8 a@b a@b.c @x.y 4111 1111 1111 1112 +1-2 +123456789012345678 0000000000000000", "es", "c"),
    (10, "Licensed under the Apache License, Version 2.0. CC BY CC BY-SA 4.0 the GNU General Public License mit license", "en", "c"),
    (11, "日本語の文章 と emoji 😀😀 mixed with ASCII a\u0000b", "ja", "c"),
    (12, "one two", "en", "c"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 0, True, 0, 0, "x") for i, t, lang, s in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return table(spark, sf, "labels")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(rows, expected):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(map(tuple, expected), key=key)


# 1: quality rules


def brute_quality(own, trusted, buckets=quality.BUCKETS):
    def grams(w):
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        # a number is hashed as its eight bytes, the second one seeded with the first one's hash
        pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
        return [signed(x) % buckets for x in h] + [signed(pair(a, b)) % buckets for a, b in zip(h, h[1:], strict=False)]

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in own]
    raw, target = Counter(), Counter()
    for (i, _), w in zip(own, words, strict=True):
        g = grams(w)
        raw.update(g)
        if i in trusted:
            target.update(g)
    weight = None
    if target:
        r, t = raw.total(), target.total()
        weight = [round(1e6 * (np.log(target[b] + 1) - np.log(raw[b] + 1) + np.log(r + buckets) - np.log(t + buckets))) for b in range(buckets)]
    out = []
    for (i, text), w in zip(own, words, strict=True):
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        counts = Counter(windows)
        covered = {k + d for k, x in enumerate(windows) if counts[x] > 1 for d in range(5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        g = grams(w)
        good = weight is None or sum(weight[b] for b in g) >= quality.LEAST * len(g)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed, not failed and good))
    return out


def quality_rows(df, labels):
    return quality.report(df, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()


def test_quality_brute(docs, labels):
    trusted = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()}
    same(quality_rows(docs, labels), brute_quality(texts(docs), trusted))


def test_quality_edges(spark, edge, empty, labels):
    trusted = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (6, None, None), (10, 1, None)], "doc_id bigint, quality int, toxic int")
    same(quality_rows(edge, trusted), brute_quality(texts(edge), {1, 10}))
    same(quality_rows(edge, trusted.where("false")), brute_quality(texts(edge), set()))
    assert quality_rows(empty, labels) == []
    assert quality.filtered(edge, trusted).columns == edge.columns


def test_quality_ratio_of_texts_without_words(spark, labels):
    own = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, " \t\n\x0b")], "doc_id bigint, text string")
    for trusted in (spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int"), labels.where("false")):
        found = {r["doc_id"]: r for r in quality.report(own, trusted).collect()}
        assert all((found[k]["n_words"], found[k]["base_failed"], found[k]["ratio"], found[k]["kept"]) == (0, True, None, False) for k in (2, 3, 4))
        assert (found[1]["ratio"] is None) == trusted.isEmpty()


def test_quality_bounds_the_trusted_sample(docs, labels):
    some = quality.weights(docs, labels, trusted_rows=20)
    assert len(some) == quality.BUCKETS and some != quality.weights(docs, labels)


# 2: language identification


def test_language_held_out_accuracy(spark, sf, docs):
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)
    assert np.mean([r["accepted"] for r in found]) > 0.9


def test_language_ignores_held_out_labels(docs):
    wrong = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    same(langid.identify(wrong).collect(), langid.identify(docs).collect())


def test_language_edges(edge, empty):
    rows = {(r["doc_id"], r["lang_pred"]): r for r in langid.identify(edge).collect()}
    for k in (3, 4, 5):
        assert rows[(k, "und")]["score"] == 0 and not rows[(k, "und")]["accepted"]
    assert langid.identify(empty).collect() == []
    assert {r["lang_pred"] for r in langid.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    model = langid.fit(edge)
    assert set(model["languages"]) <= {"en", "fr", "de", "es", "ja"}


def test_language_segments_change_nothing(monkeypatch, docs):
    model = langid.fit(docs)
    some = [t for _, t in texts(docs)][:40] + [None, "", "é" * 300]
    whole = langid.scores(model, some)
    monkeypatch.setattr(langid, "SEGMENT", 97)
    parts = langid.scores(model, some)
    assert (whole[1] == parts[1]).all() and np.allclose(whole[0], parts[0])
    alone = np.concatenate([langid.scores(model, [t])[0] for t in some])
    assert np.allclose(whole[0], alone)


# 3: decontamination


def brute_contamination(own, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = word(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[k : k + 13])].add("null" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in own:
        w, hit, those = word(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    those |= found
        out.append((i, len(w), len(hit), len(those), hashlib.sha256(",".join(sorted(those)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 2000])
def test_contamination_brute(spark, sf, docs, block_words):
    items = table(spark, sf, "benchmark")
    same(decontaminate.report(docs, items, block_words=block_words).collect(), brute_contamination(texts(docs), [tuple(r) for r in items.select("item_id", "text").collect()]))


def test_contamination_edges(spark, edge, empty):
    items = [(1, "Word word"), (1, "Word word"), (2, None), (3, "--"), (None, "Quick  BROWN fox"), (4, "日本語の文章"), (5, "word " * 15), (6, "dog again and again the"), (7, "au 33 1 23")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    same(decontaminate.report(edge, bench).collect(), brute_contamination(texts(edge), items))
    same(decontaminate.report(edge, bench.where("false")).collect(), brute_contamination(texts(edge), []))
    assert decontaminate.report(empty, bench).collect() == []


def test_windows_equal_all_windows():
    rng = np.random.default_rng(11)
    few = lambda n: " ".join("abcd"[k] for k in rng.integers(0, 4, n))
    runs = [few(n) for n in (40, 60, 25)]
    cut = lambda: " ".join(runs[rng.integers(3)].split()[rng.integers(0, 20) :][: rng.integers(1, 40)])
    items = [(k, cut()) for k in range(60)] + [(100 + k, few(rng.integers(5, 30))) for k in range(30)]
    own = [(k, f"{few(rng.integers(0, 9))} x {cut()} y {cut()}") for k in range(300)]
    machine = decontaminate.Machine([(str(i), t) for i, t in items])
    found = []
    for k, t in own:
        n, hits, those = decontaminate.scan(machine, t)
        names = sorted({str(items[x][0]) for x in those})
        found.append((k, n, len(hits), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hits) and 20 * len(hits) >= n))
    assert found == brute_contamination(own, items)
    assert len(machine.lengths) < sum(len(t.split()) for _, t in items) / 3


def test_contamination_offsets(edge, spark):
    bench = spark.createDataFrame([(7, "Dupont exemple"), (8, "serveur 10 0 0 1")], "item_id bigint, text string")
    rows = decontaminate.contamination(edge, bench).where("size(contamination.hits) > 0").collect()
    assert [[r["text"][h["start"] : h["end"]] for h in r["contamination"]["hits"]] for r in rows] == [["Dupont", "exemple", "serveur", "10", "0", "0", "1"]]


# 4: WARC


def brute_warc(pages):
    groups = defaultdict(list)
    for i, html in pages:
        groups[html or ""].append(i)
    out = []
    for i, html in pages:
        data, known = (html or "").encode(), [x for x in groups[html or ""] if x is not None]
        first = max(known, default=None)
        other = first is not None and first != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if other else "response", first if other else None))
    return out


def test_warc_brute(spark, sf):
    pages = table(spark, sf, "pages")
    again = pages.limit(40).withColumn("page_id", F.col("page_id") + 100_000)
    both = pages.unionByName(again)
    same(warc.round_trip(both).collect(), brute_warc([(r["page_id"], r["html"]) for r in both.collect()]))


def test_warc_edges(spark):
    rows = [(1, "http://a/\r\nX: y", "é" * 100_000), (2, None, None), (3, "http://b", ""), (4, "", "same"), (5, "u", "same"), (5, "u", "same"), (None, "u", "same"), (None, None, "alone"), (9, "u", "\r\n\r\nWARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    same(warc.round_trip(pages).collect(), brute_warc([(i, h) for i, _, h in rows]))
    assert warc.round_trip(pages.where("false")).collect() == []


def test_warc_folders(spark, sf, tmp_path):
    pages = table(spark, sf, "pages").limit(30)
    expected = brute_warc([(r["page_id"], r["html"]) for r in pages.collect()])
    for folder in (f"{tmp_path}/plain", f"file:{tmp_path}/short", f"file://{tmp_path}/full"):
        same(warc.read(warc.write(pages, folder), folder, with_payload=False).collect(), expected)
        assert list((tmp_path / folder.rpartition("/")[2]).glob("*.warc.gz"))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    before = hadoop.get("fs.defaultFS")
    hadoop.set("fs.defaultFS", "hdfs://far:8020/")
    try:
        assert warc.located(storage.qualified(spark, "/shared/warc")) == "hdfs://far:8020/shared/warc"
        assert warc.located(storage.qualified(spark, "file:/shared/warc")) == "file:///shared/warc"
    finally:
        hadoop.set("fs.defaultFS", before)
    assert warc.located("s3a://bucket/warc") == "s3://bucket/warc"
    with pytest.raises(ValueError):
        warc.located("/shared/warc")


def test_tables_set_nothing_in_the_session(spark, sf):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for q in ("op3_decontamination", "op9_pii"):
        queries()[q](spark, sf)
    assert spark.conf.get(name) == before


def test_component_rounds_leave_one_table(spark):
    before = set(storage.written(spark))
    simhash.components(spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))).count()
    assert len(set(storage.written(spark)) - before) == 1


def test_warc_reader_streams_and_verifies():
    both = warc.record(1, "u", b"a" * 5000, None, None) + warc.record(2, "u", b"b", 1, "v")
    data = iter([both[k : k + 7] for k in range(0, len(both), 7)])
    found = [warc.parse(m) for m in warc.members(lambda: next(data, b""))]
    assert [(r["page_id"], r["record_type"], r["payload_bytes"], r["refers_to"]) for r in found] == [(1, "response", 5000, None), (2, "revisit", 1, 1)]
    assert found[0]["payload"] == b"a" * 5000 and found[1]["fields"]["warc-refers-to-target-uri"] == "v"
    with pytest.raises(warc.WarcError):
        parts = iter([both[:-3]])
        list(warc.members(lambda: next(parts, b"")))
    parts = iter([both])
    member = next(warc.members(lambda: next(parts, b"")))
    with pytest.raises(warc.WarcError):
        warc.parse(member.replace(b"aaaaa", b"aaaab", 1))
    with pytest.raises(warc.WarcError):
        warc.parse(member[:-1])


# 5: SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(prints):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(set(prints))
    parent = {x: x for x in distinct}
    for a in distinct:
        for b in distinct:
            if a < b and (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in distinct}


def brute_simhash(own):
    prints = [brute_fingerprint(t) for _, t in own]
    root = brute_components(prints)
    least = {}
    for (i, _), p in zip(own, prints, strict=True):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return [(i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(own, prints, strict=True)]


def test_simhash_brute(docs):
    same(simhash.near_duplicates(docs).collect(), brute_simhash(texts(docs)))


def test_simhash_edges(edge, empty):
    same(simhash.near_duplicates(edge).collect(), brute_simhash(texts(edge)))
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.one_of_each(edge)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 9, 10, 11, 12]


def random_prints(n=3000, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    out = set(rng.integers(0, 1 << 63, 200, dtype=np.uint64).tolist())
    while len(out) < n:
        x = int(centres[rng.integers(len(centres))])
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


def test_one_of_each_with_equal_and_missing_keys(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in ("alpha", "beta", "gamma", "delta"))
    rows = [(1, a), (1, b), (2, a), (None, b), (None, c), (None, c), (3, d), (3, d), (0, None)]
    kept = [tuple(r) for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (None, c), (3, d), (0, None)], key=str)


def test_trie_walk_finds_every_pair():
    values = random_prints(900)
    i, j = simhash.linked_pairs(values, np.array([0, len(values)]), np.array([0]))
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    assert found == {(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)}
    assert len(i) == len(found)


def test_paths_order_all_bits():
    values = random_prints(50)
    for path in (3, 5, 9, 17, 33, 100):
        shared, free = simhash.bits_of(path)
        assert sorted(shared + free) == list(range(64))
        for x, y in zip(values.tolist(), simhash.arranged(values, shared + free).tolist(), strict=True):
            assert f"{y:064b}" == "".join(f"{x:064b}"[k] for k in shared + free)


@pytest.mark.parametrize("limit", [1, 40, 100_000])
def test_components_of_tries_dealt_again(spark, limit):
    values = random_prints()
    frame = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp bigint")
    found = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in simhash.components(simhash.links(frame, limit)).collect()}
    expected = brute_components([int(x) for x in values])
    groups = lambda of: {frozenset(x for x in g) for g in _grouped(of).values() if len(g) > 1}
    assert groups(found) == groups(expected)


def _grouped(of):
    out = defaultdict(set)
    for x, r in of.items():
        out[r].add(x)
    return out


def test_components_of_a_long_path(spark):
    path = spark.range(400).select((F.col("id") * 7919 % 401).alias("u"), ((F.col("id") + 1) * 7919 % 401).alias("v"))
    assert {r["root"] for r in simhash.components(path).collect()} == {0}


# 6: sharding


def check_shards(own, rows, loose):
    assert len(rows) == len(own)
    key = lambda t: (t[0] is None, t)
    crc = __import__("zlib").crc32
    assert sorted(((i, len((t or "").encode()) + 1, crc((t or "").encode())) for i, t in own), key=key) == sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=key)
    slots, total = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    fair = sum(total.values()) / 8
    assert all(abs(total[k] - fair) <= loose + 0.01 * fair for k in range(8))


def test_shards(docs, spark):
    for rows_per_range in (250_000, 3):
        rows = sharding.shard(docs, rows_per_range=rows_per_range).collect()
        check_shards(texts(docs), rows, max(r["size"] for r in rows))
        whole, _ = brute_homes(texts(docs))
        assert all(len(s) == 1 for t, s in shards_of_groups(texts(docs), rows).items() if t in whole)


def shards_of_groups(rows, found):
    text, out = defaultdict(set), defaultdict(set)
    for i, t in rows:
        text[i].add(t or "")
    for r in found:
        for t in text[r["doc_id"]]:
            out[t].add(r["shard"])
    return out


def brute_homes(rows, shards=8):
    """Groups that must be whole: largest first, each on the emptiest shard if it fits there."""
    size = Counter()
    for _, t in rows:
        size[t or ""] += len((t or "").encode()) + 1
    total, load, whole = size.total(), [0] * shards, set()
    for t, n in sorted(size.items(), key=lambda x: -x[1]):
        if n <= total / shards * sharding.LARGE:
            whole.add(t)
        elif min(load) + n <= total / shards:
            load[load.index(min(load))] += n
            whole.add(t)
    return whole, total / shards


@pytest.mark.parametrize("sizes", [[900], [1200, 300, 250], [500] * 9, [40] * 12 + [600]])
@pytest.mark.parametrize("rows_per_range", [250_000, 10])
def test_shards_keep_groups_that_fit(spark, sizes, rows_per_range):
    rows = [(1_000_000 * (g + 1) + k, f"hot text {g:03d}") for g, n in enumerate(sizes) for k in range(n)] + [(100_000 + k, f"text {k:06d}") for k in range(900)]
    rows += [(200_000 + k, None if k % 2 else "") for k in range(300)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), rows_per_range=rows_per_range).collect()
    whole, fair = brute_homes(rows)
    check_shards(rows, found, 2 * sharding.LARGE * fair + 20)
    split = {t for t, s in shards_of_groups(rows, found).items() if len(s) > 1}
    size = Counter(t or "" for _, t in rows)
    # of groups of one size any may be the one that no longer fits
    torn, loose = Counter((size[t], len(t)) for t in split), Counter((size[t], len(t)) for t in set(size) - whole)
    assert torn <= loose


def test_shards_of_equal_rows(spark):
    rows = [(None, "same")] * 400 + [(7, "same")] * 300 + [(k, f"text {k}") for k in range(100)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), rows_per_range=20).collect()
    check_shards(rows, found, 20)


def test_shards_edges(edge, empty):
    rows = sharding.shard(edge).collect()
    check_shards(texts(edge), rows, max(r["size"] for r in rows))
    assert sharding.shard(empty).collect() == []


# 7: substring duplicates


def test_gear_equals_its_recurrence():
    words = np.random.default_rng(1).integers(0, 1 << 63, 300, dtype=np.uint64)
    back = substring.HASHED_WORDS - 1
    h = [sum(int(g) << k for k, g in enumerate(substring.GEAR[words[max(0, i - back) : i + 1] & np.uint64(0xFFFF)][::-1])) & 0xFFFFFFFF for i in range(len(words))]
    assert substring.gear(words).tolist() == h


def test_every_run_of_boundaries_has_a_cut():
    rng = np.random.default_rng(8)
    for n in (0, 1, 4, 5, 300):
        h = rng.integers(0, 50, n)
        found = substring.cuts(h).tolist()
        expected = {min(range(a, min(a + substring.REACH, n)), key=lambda i: (h[i], i)) for a in range(max(1, n - substring.REACH + 1))} if n else set()
        assert found == sorted(expected)


def test_digests_are_those_of_the_words_alone():
    rng = np.random.default_rng(2)
    for n in (60, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([rng.integers(0, 1 << 63, 37, dtype=np.uint64), a])
        first, past = np.array([0, 3, n - 50]), np.array([45, 50, n])
        assert (substring.digests(a, first, past) == substring.digests(b, first + 37, past + 37)).all()
        assert len(set(substring.digests(a, first, past).tolist())) == 3


def test_an_insertion_moves_no_far_cuts():
    rng = np.random.default_rng(12)
    words = make_prose(rng, 400, 1, 9).split()
    before, after = (set(substring.chunks(" ".join(w))[0].tolist()) for w in (words, words[:200] + ["new", "words"] + words[200:]))
    assert len(before & after) > 0.7 * len(before)


def make_prose(rng, n, low, high):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(low, high + 1))) for _ in range(n))


def shared_words(own, n):
    """By number of the text: the words inside any run of ``n`` words that another text has too, from all runs of all texts."""
    split = [(t or "").encode().split() for _, t in own]
    holders = defaultdict(set)
    for k, w in enumerate(split):
        for i in range(len(w) - n + 1):
            holders[tuple(w[i : i + n])].add(k)
    out = defaultdict(set)
    for k, w in enumerate(split):
        for i in range(len(w) - n + 1):
            if len(holders[tuple(w[i : i + n])]) > 1:
                out[k] |= set(range(i, i + n))
    return out


SURE = substring.LEAD + 2 * substring.REACH - 1


def overlapping_texts(rng, low, high, n=120):
    """Texts cut out of a few long runs, so that they share passages of all lengths with different partners."""
    runs = [make_prose(rng, 160, low, high).split() for _ in range(n // 6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(1, 4)):
            run = runs[rng.integers(len(runs))]
            a = rng.integers(0, 120)
            parts += make_prose(rng, rng.integers(0, 12), low, high).split() + run[a : a + rng.integers(20, 90)]
        out.append(" ".join(parts))
    return out


def words_of_spans(text, rows):
    places = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    return {k for r in rows for k, (a, b) in enumerate(places) if r["start"] <= a and b <= r["end"]}


@pytest.mark.parametrize("low, high", [(1, 1), (1, 12)])
def test_long_runs_are_found_and_short_ones_never(spark, low, high):
    rng = np.random.default_rng(low + high)
    own = list(enumerate(overlapping_texts(rng, low, high)))
    found = defaultdict(list)
    for r in substring.repeats(spark.createDataFrame(own, "doc_id bigint, text string")).collect():
        found[r["doc_id"]].append(r)
        assert r["n_words"] == len(own[r["doc_id"]][1][r["start"] : r["end"]].split()) > substring.LEAD
    sure, possible = shared_words(own, SURE), shared_words(own, substring.LEAD + 1)
    assert sure and len(possible) > len(sure)
    for k, text in own:
        marked = words_of_spans(text, found[k])
        assert bool(found[k]) or k not in sure
        assert marked <= possible[k]
    # of a run of SURE words or more at least the chunk inside is marked
    assert all(len(words_of_spans(own[k][1], found[k]) & sure[k]) > substring.LEAD for k in sure)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_have_one_holder_and_no_word_is_lost(spark, seed):
    rng = np.random.default_rng(seed)
    own = [(int(k), t) for k, t in zip(rng.permutation(120), overlapping_texts(rng, 2, 9), strict=True)]
    run = make_prose(rng, 140, 2, 9).split()
    own += [(205, " ".join(run)), (201, " ".join(run[:80])), (209, " ".join(run[60:]))]
    frame, text = spark.createDataFrame(own, "doc_id bigint, text string"), dict(own)
    rows = substring.repeats(frame).collect()
    for r in rows:
        span = text[r["doc_id"]][r["start"] : r["end"]]
        assert r["first"] == (r["first_id"] == r["doc_id"]) and r["first_id"] <= r["doc_id"]
        w, theirs = span.split(), f" {' '.join(text[r['first_id']].split())} "
        for i in range(len(w) - substring.LEAD):  # each window of LEAD + 1 words stands in the first holder
            assert f" {' '.join(w[i : i + substring.LEAD + 1])} " in theirs
    assert {r["first_id"] for r in rows if r["doc_id"] == 209} == {205} and not any(r["first"] for r in rows if r["doc_id"] == 209)
    left = {r["doc_id"]: r["text"] for r in substring.without_repeats(frame).collect()}
    assert sum(map(len, left.values())) < sum(map(len, text.values()))
    assert set(" ".join(left.values()).split()) == set(" ".join(text.values()).split())
    assert set(" ".join(left[k] for k in (201, 205, 209)).split()) == set(run)


def test_repeats_of_planted_passages(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: make_prose(rng, n, 2, 9)
    passages = [prose(n) for n in (51, 60, 80, 120)] * 5
    rows, planted = [], set()
    for k, p in enumerate(passages):
        rows += [(2 * k, f"{prose(90)} {p} {prose(40)}"), (2 * k + 1, f"{prose(33)}\n{p} {prose(10)}")]
        planted |= {2 * k, 2 * k + 1}
    short = prose(substring.LEAD)
    rows += [(1000 + k, f"{prose(50)} {short} {prose(50)}") for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = substring.repeats(frame).collect()
    assert {r["doc_id"] for r in found} == planted
    left = {r["doc_id"]: r["text"] for r in substring.without_repeats(frame).collect()}
    text = dict(rows)
    assert all(len(left[k]) < len(text[k]) for k in planted if not any(r["first"] for r in found if r["doc_id"] == k))
    assert all(left[k] == text[k] for k in text if k >= 1000)


def test_repeats_on_documents(docs):
    own = texts(docs)
    found = {r["doc_id"] for r in substring.repeats(docs).collect()}
    assert {own[n][0] for n in shared_words(own, SURE)} <= found <= {own[n][0] for n in shared_words(own, substring.LEAD + 1)}


def test_repeats_edges(spark, edge, empty):
    assert {r["doc_id"] for r in substring.report(edge).collect()} == {1, 2} - {1, 2}
    assert substring.report(empty).collect() == []
    assert substring.without_repeats(edge).count() == edge.count()
    a, b = (make_prose(np.random.default_rng(k), 60, 2, 9) for k in (1, 2))
    twice = f"{a} x {a}"
    rows = [(1, a, 1, "x", 2), (1, a, 1, "x", 2), (None, a, 1, "x", 2), (None, a, 1, "x", 2), (2, a.replace(" ", "\n\t"), 1, "x", 2), (3, twice, 1, "x", 2), (4, b + " " + b, 1, "x", 2), (None, a + " ende", 1, "x", 2)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, key int, hash string, spans int")
    found = [(r["doc_id"], r["n_words"], r["n_texts"], r["first_id"], r["first"]) for r in substring.report(frame).collect()]
    assert Counter((k, i, f) for k, _, _, i, f in found) == {(1, 1, True): 1, (None, 1, False): 2, (2, 1, False): 1, (3, 1, False): 2}
    assert all(n == 7 and w <= 60 and (w == 60 or k in (3, None)) for k, w, n, _, _ in found)
    left = substring.without_repeats(frame)
    assert left.columns == frame.columns
    rest = sorted(((r["doc_id"], len(r["text"].split())) for r in left.collect()), key=str)
    # a run inside a text may keep fewer than two chunks at either end
    assert [k for k, _ in rest] == [1, 1, 2, 3, 4, None, None, None]
    assert [n for _, n in rest][:3] == [60, 60, 0] and rest[4][1] == 120 and rest[3][1] <= 1 + 4 * 2 * substring.REACH and max(n for k, n in rest if k is None) <= 1 + 2 * substring.REACH


# 8: licences


def as_regex(template):
    out = ""
    for kind, *given in licenses.parsed(template):
        if kind == "var":
            out += (f"(?: (?:{given[0]}))" if given[0] != ".+" else "(?: [^ ]+)") + "{%d,%d}" % (given[2], given[1])
        else:
            body = " " + " ".join(map(re.escape, given[0]))
            out += f"(?:{body})?" if kind == "may" else body
    return re.compile(out + "(?= )")


def brute_licences(own):
    out = []
    for i, t in own:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        joined = f" {' '.join(w)} "
        more = {label for label, x in licenses.TEMPLATES.items() if as_regex(x).search(joined)}
        base = {label for _, label in places}
        score = 1.0 if more else 0.5 if places else 0.0
        out.append((i, len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score))
    return out


def test_licences_brute(docs):
    same(licenses.report(docs).collect(), brute_licences(texts(docs)))


def test_licences_edges(edge, empty):
    same(licenses.report(edge).collect(), brute_licences(texts(edge)))
    assert licenses.report(empty).collect() == []


def test_automaton_regions():
    machine = licenses.Automaton("grant <<beginOptional>>full and free<<endOptional>> use of <<var;match=[a-z]+;max=2>> here")
    runs = lambda t: machine.runs(t.split())
    assert runs("x grant use of y z here") == [(1, 7)]
    assert runs("grant full and free use of here") == [(0, 7)]
    assert runs("grant full free use of here") == []
    assert runs("grant use of 7 here") == [] and runs("grant use of a b c here") == []
    some = licenses.Automaton("the <<var;match=a|b;max=3;min=2>> end")
    assert [some.runs(t.split()) for t in ("the end", "the a end", "the a b end", "the a b a end", "the a b a b end")] == [[], [], [(0, 4)], [(0, 5)], []]
    assert runs("grant grant use of here grant use of q here") == [(1, 5), (5, 10)]


def filled(template, optional):
    """Words of a text that the template stands for, and places of the mandatory ones."""
    out, mandatory = [], []
    for kind, *given in licenses.parsed(template):
        if kind == "must":
            mandatory.extend(range(len(out), len(out) + len(given[0])))
            out.extend(given[0])
        elif kind == "may":
            out.extend(given[0] if optional else [])
        elif given[0] == ".+":
            out.append(f"holder{len(out)}")
        elif given[2]:
            out.append(given[0].split("|")[0])
    return out, mandatory


def test_whole_licences(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
    commented = "\n".join(f" * {line}" for line in mit.split("\n"))
    changed = mit.replace("free of charge", "for a charge")
    cut = mit.replace("FITNESS FOR A PARTICULAR PURPOSE AND ", "")
    rows = [(0, mit), (1, f"x = 1\n{commented}\ny = 2"), (2, changed), (3, cut), (4, mit + "\n\n" + mit)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = {r["doc_id"]: r["labels"] for r in licenses.report(df).collect()}
    assert labels == {0: "mit-license,mit-text", 1: "mit-license,mit-text", 2: "", 3: "mit-text", 4: "mit-license,mit-text"}
    same(licenses.report(df).collect(), brute_licences(rows))


def test_every_template_accepts_its_own_wording(spark):
    """Filled in, each template is accepted; without any one of three mandatory words it is not."""
    rows, wanted = [], []
    for label, template in licenses.TEMPLATES.items():
        for optional in (False, True):
            own, mandatory = filled(template, optional)
            for gone in (None, mandatory[0], mandatory[len(mandatory) // 2], mandatory[-1]):
                text = " ".join(w for k, w in enumerate(own) if k != gone)
                rows.append((len(rows), f"before {text} after"))
                wanted.append((label, gone is None))
    got = licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same(got, brute_licences(rows))
    for r in got:
        label, accepted = wanted[r["doc_id"]]
        assert accepted == (label in r["labels"].split(",")), (label, accepted, r["labels"])
    gpl = next(r["labels"] for r in got if wanted[r["doc_id"]] == ("gpl-header", True))
    assert "lgpl-header" not in gpl


# 9: personal data


def plain_spans(text):
    text = text or ""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = ["a@b.c@d.e", "..@a.b", "x@a..b", "a@b.c.", "1.1.1.1.1.1.1.1", "01.002.0003.00004", "4111 1111 1111 1111-4111", "+1 (2) 3-4 5 6 7 8 9+12345678", "é@x.yé", "+(1)23456789", "a" * 300 + "@" + "b" * 300, "1" * 400, "%@%.%", "a@b@c.d", "4111--1111 1111 1111 1111", "+12345678 .", "999.1.1.1.1"]


def test_base_spans_equal_the_patterns(docs):
    rng = np.random.default_rng(2)
    random = ["".join(rng.choice(list("a1.@+ -()é4"), 60)) for _ in range(3000)]
    for t in [t for _, t in texts(docs)] + [t for _, t, *_ in ROWS if t != "x" * 50_000] + TRICKY + random:
        assert [x[:3] for x in pii.base_spans(t)] == plain_spans(t), t


def test_pii_report(edge, empty, docs):
    for df in (edge, docs):
        for r in pii.report(df).collect():
            spans = r["spans"].split(",") if r["spans"] else []
            base = [s for s in spans if not s.startswith("term")]
            assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in base) for k in pii.KINDS]
    assert pii.report(empty).collect() == []


def telling_docs(spark):
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 6, 3)) for _ in range(n))
    rows = [(k, f"{prose(20)} surgeon zelenka wrote from anna@clinic.org {prose(20)}") for k in range(5)] + [(100 + k, f"{prose(30)} surgeon {prose(10)}") for k in range(60)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), rows


@pytest.mark.parametrize("broadcast_rows", [pii.BROADCAST_ROWS, 0])
def test_disclosing_terms(spark, broadcast_rows):
    frame, rows = telling_docs(spark)
    found = {r["doc_id"]: r for r in pii.with_spans(frame, broadcast_rows=broadcast_rows).collect()}
    for k, text in rows:
        terms = {text[s["start"] : s["end"]] for s in found[k]["pii"] if s["kind"] == "term"}
        assert ("zelenka" in terms) == (k < 5) and "surgeon" not in terms
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    assert "anna@" not in clean[0] and "<EMAIL>" in clean[0] and "<TERM>" in clean[0] and "zelenka" not in clean[0] and clean[100] == dict(rows)[100]


def test_disclosure_figures(spark):
    frame, rows = telling_docs(spark)
    found = {r["term"]: r["disclosure"] for r in pii.disclosures(frame, threshold=-10).collect()}
    n_t = sum("surgeon" in t for _, t in rows)
    assert found["zelenka"] == pytest.approx(1.0)
    assert found["surgeon"] == pytest.approx(np.log(5 * len(rows) / (5 * n_t)) / np.log(len(rows) / 5))


@pytest.mark.parametrize("broadcast_rows", [pii.BROADCAST_ROWS, 0])
def test_terms_of_entities_in_one_or_two_texts(spark, broadcast_rows):
    _, rows = telling_docs(spark)
    new = [(201, "surgeon zelenka or Li wrote from anna@clinic.org"), (202, "call surgeon Wu Novotna at +420 777 123 456 aba"), (203, "surgeon 王伟, +420 777 123 456")]
    frame = spark.createDataFrame(rows[5:] + new, "doc_id bigint, text string")
    found = {r["doc_id"]: {r["text"][s["start"] : s["end"]] for s in r["pii"] if s["kind"] == "term"} for r in pii.with_spans(frame, broadcast_rows=broadcast_rows).collect()}
    assert {"zelenka", "Li"} <= found[201] and {"Wu", "Novotna"} <= found[202] and "王伟" in found[203]
    assert not any({"surgeon", "aba"} & found[k] for k, _ in new) and not any(found[k] for k, _ in rows[5:])


def test_context_equals_a_plain_search():
    rng = np.random.default_rng(21)
    for _ in range(300):
        text = "".join(rng.choice(list("abc é.,7") + ["x" * 300, " " * 700], rng.integers(1, 60)))
        a = int(rng.integers(0, len(text) + 1))
        b = int(rng.integers(a, len(text) + 1))
        words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text[:a])][::-1], [(m[0].lower(), m.start() + b, m.end() + b) for m in re.finditer(r"[^\W\d_]+", text[b:])]
        expected = []
        for side in words:
            at = [k for k, (w, _, _) in enumerate(side) if len(w) >= 3][pii.CONTEXT_WORDS - 1 :][:1]
            expected += side[: at[0] + 1] if at else side
        assert list(pii.near(text, a, b)) == expected


def test_context_keeps_its_long_words():
    words = [f"w{'x' * k}ord" for k in range(1, 12)]
    text = "a@b.org " + " of ".join(words)
    terms = [t for t, _, _ in pii.near(text, 0, 7)]
    assert [t for t in terms if t != "of"] == words[:8] and terms.count("of") == 7


def test_redaction_of_nulls_and_overlaps(edge):
    rows = {r["doc_id"]: r["text"] for r in pii.redact(edge).collect()}
    assert rows[3] is None and rows[4] == "" and rows[6] == LONG
    assert not pii.base_spans(rows[None])


# 10: byte-level BPE


def reference():
    import tiktoken

    path, pattern = tokenizer()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


def test_merge_equals_the_library():
    coder, ranks = reference(), bpe.load_ranks(tokenizer()[0])
    rng = np.random.default_rng(6)
    pieces = [bytes(rng.choice(list(b"abeinrst"), n).astype(np.uint8)) for n in (1, 2, 3, 5, 8, 13, 40, 500, 4000)] + [b"a" * n for n in (1, 2, 3, 7, 100, 1001)] + [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (10, 1000)]
    for piece in pieces:
        assert bpe.merge(piece, ranks) == coder._encode_single_piece(piece)


def test_merges_side_by_side_equal_the_library(docs):
    coder, ranks = reference(), bpe.load_ranks(tokenizer()[0])
    rng = np.random.default_rng(13)
    pieces = ["".join(rng.choice(list("abeinrst éß日😀"), rng.integers(1, 70))) for _ in range(600)] + ["a" * n for n in range(1, 70)]
    pieces += [p for _, t in texts(docs)[:30] for p in bpe.splitter(tokenizer()[1])(t or "")]
    found = bpe.Merger(ranks).ids(pieces)
    assert [np.frombuffer(x, np.int32).tolist() for x in found] == [coder._encode_single_piece(p.encode()) for p in pieces]
    assert [bpe.merge(p.encode(), ranks) for p in pieces[:300]] == [np.frombuffer(x, np.int32).tolist() for x in found[:300]]


def test_tokens_brute(docs, edge, empty):
    coder = reference()
    for df in (docs, edge):
        expected = []
        for i, t in texts(df):
            ids = coder.encode_ordinary(t or "")
            expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        same(bpe.round_trip(df, *tokenizer()).collect(), expected)
    assert bpe.round_trip(empty, *tokenizer()).collect() == []


def test_all_queries_are_registered():
    assert [int(re.match(r"op(\d+)_", name)[1]) for name in queries()] == list(range(1, 14))

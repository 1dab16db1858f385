"""Language predictions, disclosing terms and pipeline stages recomputed in plain Python over whole tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from chronoloom.llm import langid, pii
from chronoloom.llm.queries import queries
from chronoloom.llm.shared import table

M32 = (1 << 32) - 1


def plain_subwords(text):
    """Buckets of all windows of two to four characters: letters, with one mark before a word and, but for the longest, one inside or after it."""
    own = [0] + [ord(c) if c.isalpha() else 0 for c in (text or "").lower()] + [0] * 4
    shift = 32 - (langid.BUCKETS.bit_length() - 1)
    for at in range(len(own) - 4):
        c = own[at : at + 4]
        if not c[1]:
            continue
        h = (c[0] * 0x9E3779B1 + c[1] * 0x85EBCA77) & M32
        for n in (2, 3, 4):
            if n == 4 and not c[2]:
                continue
            if n > 2:
                h = (h * 0xC2B2AE3D + c[n - 1] * 0x27D4EB2F) & M32
            mixed = (h ^ (h >> 15)) * (0x2C1B3C6D + 2 * n) & M32
            yield mixed >> shift


def test_every_language_is_recomputed(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.fit(docs)
    found = {r["doc_id"]: r for r in queries()["op2_language_id"](spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for r in rows:
        counts = Counter(plain_subwords(r["text"]))
        own = found[r["doc_id"]]
        assert own["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not counts:
            assert (own["lang_pred"], own["score"], own["accepted"]) == ("und", 0.0, False)
            continue
        mean = sum(n * model["table"][b].astype(float) for b, n in counts.items()) / sum(counts.values())
        z = (mean + model["bias"]) / model["temperature"]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert own["score"] == pytest.approx(p.max(), abs=1e-6)
        assert own["lang_pred"] == model["languages"][int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-6
        assert own["accepted"] == (own["score"] >= model["least"])


def near_terms(text, start, end, union):
    """(term, start, end) among the words up to the eighth long one on either side that touch no base span."""
    words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text)]
    # on the left a word may begin or end at the span; a run of letters is cut where the span begins
    left = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text[:start])][::-1]
    right = [(m[0].lower(), m.start() + end, m.end() + end) for m in re.finditer(r"[^\W\d_]+", text[end:])]
    assert words or not (left or right)
    out = []
    for side in (left, right):
        long = 0
        for term, a, b in side:
            out.append((term, a, b))
            long += b - a >= 3
            if long == 8:
                break
    return [(t, a, b) for t, a, b in out if not any(a < y and x < b for x, y in union)]


def brute_pii(rows, threshold=pii.THRESHOLD):
    base = [pii.base_spans(t) for t in rows]
    n_entity, n_pair, n_term = Counter(), Counter(), Counter()
    near = []
    for text, spans in zip(rows, base, strict=True):
        union = [(a, b) for _, a, b, _ in spans]
        own = defaultdict(set)
        for _, a, b, e in spans:
            own[e] |= set(near_terms(text, a, b, union))
        near.append(own)
        n_entity.update(own.keys())
        n_pair.update({(e, t) for e, terms in own.items() for t, _, _ in terms})
        n_term.update({m.lower() for m in re.findall(r"[^\W\d_]+", text or "")})
    n = len(rows)
    telling = {(e, t) for (e, t), k in n_pair.items() if n_entity[e] < n and math.log(k * n / (n_entity[e] * n_term[t])) / math.log(n / n_entity[e]) >= threshold}
    return [(spans, sorted({(a, b) for e, terms in own.items() for t, a, b in terms if (e, t) in telling})) for spans, own in zip(base, near, strict=True)]


def test_every_disclosing_term_is_recomputed(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    expected = brute_pii([t for _, t in rows])
    found = {r["doc_id"]: r for r in queries()["op9_pii"](spark, sf).collect()}
    some = 0
    for (i, _), (base, terms) in zip(rows, expected, strict=True):
        said = ",".join([*(f"{k}:{a}:{b}" for k, a, b, _ in base), *(f"term:{a}:{b}" for a, b in terms)])
        assert found[i]["spans"] == said and found[i]["n_term"] == len(terms)
        some += len(terms)
    assert some


def test_disclosing_terms_of_repeated_entities(spark):
    rng = np.random.default_rng(1)
    words = [f"w{'abcdefghij'[k]}" for k in range(10)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(60)]
    texts += [f"{' '.join(rng.choice(words, 3))} maria lopez a{k % 3}@b.org {' '.join(rng.choice(words, 3))}" for k in range(9)] + [None, "", "x@y.zz", "alone@b.org"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    expected = brute_pii(texts)
    for limit in (pii.BROADCAST_ROWS, 1):  # pairs sent to all tasks, and joined
        got = {r["doc_id"]: r["pii"] for r in pii.with_spans(df, broadcast_rows=limit).collect()}
        for i, (base, terms) in enumerate(expected):
            assert [(s["kind"], s["start"], s["end"]) for s in got[i]] == [(k, a, b) for k, a, b, _ in base] + [("term", a, b) for a, b in terms]


def test_results_of_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, long texts, ties, repeated rows and columns with the operators' own names: what each stage leaves, and what it leaves alone."""
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bench = " ".join(f"question{k}" for k in range(20))
    spark.createDataFrame([(1, bench), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    prose = lambda name, n: " ".join(f"{name}{k * k}" for k in range(n))
    texts = [(1, None), (2, ""), (3, "too short"), (4, "same words " * 30), (5, prose("a", 40)), (6, prose("a", 40)), (None, prose("a", 40)), (5, prose("a", 40)), (7, prose("long", 30_000)), (8, f"{prose('b', 30)} {bench}"), (9, f"{prose('c', 30)} mail me@x.org now"), (None, prose("d", 25))]
    extra = "found string, decoded string, spans string, key string, hash string, kept boolean"
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "f", "d", "s", "k", "h", True) for i, t in texts], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")
    left, known = [], docs
    for name, stage in corpus_pipeline.STAGES:
        known = stage(spark, known, str(tmp_path)).cache()
        left.append(sorted(((r["doc_id"], r["text"]) for r in known.collect()), key=str))
        assert name == "tokens" or known.columns == docs.columns
        assert {(r["found"], r["decoded"], r["spans"], r["key"], r["hash"], r["kept"]) for r in known.collect()} == {("f", "d", "s", "k", "h", True)}
    keys = lambda rows: sorted((str(i) for i, _ in rows))
    assert keys(left[0]) == sorted(["5", "6", "None", "5", "7", "8", "9", "None"])
    assert keys(left[1]) == sorted(["5", "7", "8", "9", "None"]) and [t for i, t in left[1] if i is None] == [prose("d", 25)]
    assert keys(left[2]) == sorted(["5", "7", "9", "None"])
    after = dict(left[3])
    assert "me@x.org" not in after[9] and "<EMAIL>" in after[9] and after[7] == prose("long", 30_000) and after[None] == prose("d", 25)
    assert {r["doc_id"]: r["n_chars"] for r in known.collect()} == {i: len(t) for i, t in left[3]}
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in known.collect())

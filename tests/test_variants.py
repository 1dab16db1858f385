"""Rejects beside results, audio headers, clause repetitions and length checks."""

import re
import struct
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from chronoloom import storage
from chronoloom.functions import text as X
from chronoloom.operators import graphs as G
from chronoloom.operators import grids
from chronoloom.plans.frames import read
from chronoloom.sources import files


def chunk(kind, body):
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def test_audio_headers_wherever_chunks_stand(spark, tmp_path):
    fmt = struct.pack("<HHIIHH", 1, 2, 8_000, 32_000, 4, 16)
    sound = b"\1" * 48_000
    bodies = {
        "plain": chunk(b"fmt ", fmt) + chunk(b"data", sound),
        "list": chunk(b"LIST", b"INFOodd") + chunk(b"fmt ", fmt + b"\0\0") + chunk(b"fact", b"\0\0\0\0") + chunk(b"data", sound) + chunk(b"LIST", b"more"),
        "stream": chunk(b"fmt ", fmt) + b"data" + struct.pack("<I", 0xFFFFFFFF) + sound,
        "early": chunk(b"data", sound) + chunk(b"fmt ", fmt),
        "short": chunk(b"fmt ", fmt[:8]),
        "none": chunk(b"fmt ", fmt),
    }
    for name, body in bodies.items():
        (tmp_path / f"{name}.wav").write_bytes(b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body)
    (tmp_path / "text.wav").write_bytes(b"no sound")
    rows = {re.search(r"(\w+)\.wav", r["path"])[1]: tuple(r)[1:] for r in files.audio_headers(spark, str(tmp_path)).collect()}
    assert rows["plain"] == rows["list"] == rows["stream"] == (1.5, 8_000, 2, 16, None)
    assert rows["early"][4] == "data before format" and rows["short"][4] == "short format chunk" and rows["none"][4] == "no data chunk"
    assert rows["text"][4] == "no RIFF WAVE header" and len(rows) == 7
    assert {r["seconds"] for r in files.wav_durations(spark, str(tmp_path)).collect()} == {1.5}


def test_every_item_of_a_cell_is_a_span_or_a_reject(spark):
    cells = ["[['0:01', '0:05'], [\"1:00\", 70]]", "[['x', '2'], ['5', '5'], [1], 'loose', ['1','2','3']]", "nonsense", "", None, "[]", " [ ['00:00:01.9','00:00:03'] ] "]
    df = spark.createDataFrame(list(enumerate(cells)), "k int, cell string")
    good, bad = files.parted(df, "k", X.parse_snippet(F.col("cell")))
    assert sorted(map(tuple, good.collect())) == [(0, 1.0, 5.0), (0, 60.0, 70.0), (6, 1.0, 3.0)]
    assert sorted(map(tuple, bad.collect())) == [(1, "malformed_pair:'loose'"), (1, "malformed_pair:['1','2','3']"), (1, "malformed_pair:[1]"), (1, "non_positive_duration:['5', '5']"), (1, "unparseable_time:['x', '2']"), (2, "unparseable_cell")]


def test_rows_of_uneven_lists_are_rejects(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a", "b"]), (2, [1], ["a", "b"]), (3, None, ["a"]), (4, [], [])], "k int, a array<int>, b array<string>")
    good, bad = files.even_lists(df, "k", ["a", "b"])
    assert sorted(map(tuple, good.collect())) == [(1, 0, 1, "a"), (1, 1, 2, "b")]
    assert sorted(map(tuple, bad.collect())) == [(2, "lengths:a=1,b=2"), (3, "missing:a")]


def test_grids_that_differ_are_an_error(spark):
    a = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "gid int, idx int")
    b = spark.createDataFrame([(1, 0), (1, 1), (3, 0)], "gid int, idx int")
    assert [tuple(r) for r in grids.equal([a, b, a], "gid").collect()] == [(1, 2)]
    with pytest.raises(Exception, match="grids differ: 1 2/1"):
        grids.equal([a, b.where("idx = 0")], "gid").collect()


def plain_clauses(text):
    """Key and place of each clause."""
    out, start, at = [], 0, 0
    for m in [*re.finditer(X.CLAUSE_END, text), None]:
        end, past = (m.start(), m.end()) if m else (len(text), len(text))
        key = " ".join(re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", text[at:end]).casefold()).split())
        at = past
        if key:
            out.append([key, start, past])
            start = past
    if start < len(text):
        if out:
            out[-1][2] = len(text)
        else:
            out.append(["", 0, len(text)])
    return [tuple(x) for x in out]


def test_collapsed_clauses(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "text", X.collapse_clauses(F.col("text")).alias("c")).collect()
    some = 0
    for r in rows:
        left, whole = [tuple(x) for x in r["c"]], plain_clauses(r["text"] or "")
        assert set(left) <= set(whole) and left == sorted(left, key=lambda u: u[1])
        keys = [u[0] for u in left]
        assert not any(keys[i : i + k] == keys[i + k : i + 2 * k] for k in range(1, 9) for i in range(len(keys) - 2 * k + 1))
        if len(left) == len(whole):
            assert left == whole
        some += len(left) < len(whole)
    t = ["a, b, a, b, b, c.", "Ja!  ja. JA nein", "x. x. y. x. x. y.", "...", "", None, "...a. a"]
    found = [[tuple(x) for x in r[0]] for r in spark.createDataFrame([(x,) for x in t], "t string").select(X.collapse_clauses(F.col("t"))).collect()]
    assert [[k for k, *_ in x] for x in found] == [["a", "b", "c"], ["ja", "ja nein"], ["x", "y"], [""], [], [], ["a"]]
    assert found[2] == [("x", 0, 3), ("y", 6, 9)]
    assert {r["n"] for r in entry_module.queries()["q_collapse_clauses"](spark, sf).collect()} and some >= 0


def test_pairs_in_brackets_of_either_kind(spark):
    texts = ["(1, 2) and ( 3.5 ,4 )", "[1, 2]", " [ 1.5 ,2 ]\n", "see [1, 2]", "[1, 2] [3, 4]", "[9, 9] (5,6)", "(1 2)", "(-1, 2)", "(7, 3)", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", X.parse_pairs(F.col("t")).alias("p"))
    found = {r["k"]: [tuple(x) for x in r["p"]] for r in df.collect()}
    assert [found[k] for k in range(len(texts))] == [[(1, 2), (3.5, 4)], [(1, 2)], [(1.5, 2)], [], [], [(5, 6)], [], [], [(7, 3)], [], []]


def test_raster_of_a_rounded_down_length(spark):
    sizes = {1: 2.6, 2: 0.1, 3: None, 4: 1.0}
    spans = [(1, -3.0, 0.3), (1, 0.3, 0.3), (1, 2.2, 9.0), (1, 1.9, 1.2), (2, 0.0, 5.0), (3, 0.0, 5.0), (4, 1.0, 2.0), (4, 0.25, 0.5), (4, 0.4, 0.75), (4, None, 1.0)]
    own = spark.createDataFrame(list(sizes.items()), "gid int, duration double")
    held = spark.createDataFrame(spans, "gid int, start double, end double")
    found = {(r["gid"], r["frame"]): r["y"] for r in grids.floor_raster(held, own, 4.0).collect()}
    want = {}
    for g, d in sizes.items():
        for f in range(max(1, int((d or 0) * 4))):
            want[g, f] = int(d is not None and any(k == g and max(0, a if a is not None else 0.0) <= f / 4 < min(d, b) for k, a, b in spans))
    assert found == want
    assert grids.floor_raster(held, own.where("gid < 0"), 4.0).count() == 0


@pytest.mark.parametrize("n,block", [(3, 4), (47, 10), (60, 7)])
def test_position_graph_against_all_pairs(spark, n, block):
    r = np.random.default_rng(n)
    looks, motion = r.normal(size=(n, 3)), r.normal(size=(n, 2))
    looks[1], motion[1], looks[2] = looks[0], motion[0], 0.0
    df = spark.createDataFrame([(8, i, looks[i].tolist(), motion[i].tolist()) for i in range(n)] + [(9, 0, [1.0, 0.0, 0.0], [0.0, 0.0])], "gid int, idx bigint, look array<double>, motion array<double>")
    found = {(x["a"], x["b"]): x["w"] for x in G.position_graph(df, block, 6, 2, 0.75, 0.1).collect() if x["gid"] == 8 and x["a"] < x["b"]}
    unit = looks / (np.linalg.norm(looks, axis=1, keepdims=True) + 1e-6)
    w = np.array([[(0.75 * unit[i] @ unit[j] + 0.25 * np.exp(-np.linalg.norm(motion[i] - motion[j]))) / (1 + 0.1 * abs(i - j)) for j in range(n)] for i in range(n)])
    want = {}
    for i in range(n):
        k = max(2, 6 - i // block * block // max(1, n // 10))
        for at in range(0, n, block):
            best = sorted(range(at, min(at + block, n)), key=lambda j: (-round(w[i, j], 12), j))[:k]
            want |= {(min(i, j), max(i, j)): w[i, j] for j in best if j != i and w[i, j] > 0}
    assert found.keys() == want.keys() and all(found[e] == pytest.approx(want[e], abs=1e-12) for e in want)
    assert G.position_graph(df.where("gid < 0"), block, 6, 2, 0.75, 0.1).count() == 0


@pytest.mark.parametrize("n,wide,strip", [(47, 1, 1), (60, 2, 1), (61, 3, 2)])
def test_position_graph_in_parts_and_strips(spark, monkeypatch, n, wide, strip):
    """Parts and strips of any width, also where many weights are equal, give the edges of one part; a part's rows are shuffled once a part."""
    r = np.random.default_rng(n)
    looks, motion = r.integers(0, 2, size=(n, 2)).astype(float), np.zeros((n, 2))
    looks[20:30] = looks[5]
    df = spark.createDataFrame([(8, i, looks[i].tolist(), motion[i].tolist()) for i in range(n)], "gid int, idx bigint, look array<double>, motion array<double>")
    edges = lambda: {(x["a"], x["b"]): x["w"] for x in G.position_graph(df, 10, 6, 2, 0.75, 0.0, digits=9).collect()}
    whole = edges()
    monkeypatch.setattr(G, "WIDE", wide)
    monkeypatch.setattr(G, "STRIP", strip)
    assert whole and edges() == whole
    unit = looks / (np.linalg.norm(looks, axis=1, keepdims=True) + 1e-6)
    w = 0.75 * unit @ unit.T + 0.25
    want = set()
    for i in range(n):
        for at in range(0, n, 10):
            best = sorted(range(at, min(at + 10, n)), key=lambda j: (-round(w[i, j], 12), j))[: max(2, 6 - i // 10 * 10 // max(1, n // 10))]
            want |= {(min(i, j), max(i, j)) for j in best if j != i}
    assert whole.keys() == want


def test_position_graph_meets_few_rows_of_the_table(spark):
    """What goes to the tasks grows with the parts, not with the blocks: 1,200 positions in blocks of 20 are two parts."""
    df = spark.range(1200).select(F.lit(1).alias("gid"), F.col("id").alias("idx"), F.array(F.rand(1), F.rand(2)).alias("look"), F.array(F.rand(3), F.rand(4)).alias("motion"))
    plan = G.position_graph(df, 20, 8, 3, 0.75, 0.15)
    assert plan.count() > 0
    packed = [p for p in storage.written(spark) if "position-parts" in p][-1]
    assert spark.read.parquet(packed).count() == 2

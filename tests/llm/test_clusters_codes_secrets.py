"""Centroid clustering, vector codes and secret scans against brute force, on whole tables and on awkward rows."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import clustering, codes, secrets
from chronoloom.llm.queries import queries
from chronoloom.llm.shared import table

VECTORS = "vec_id bigint, embedding array<float>, label int, v string, cluster string, code string, key string, size int"


def squares(x, c):
    return ((x[:, None, :] - c[None]) ** 2).sum(2)


def floors(x, scale):
    return np.floor(np.array(x, dtype=np.float64) * scale).astype(np.int64)


def lloyd(x, start, rounds):
    """Plain rounds with exact means; the last assignment and its distances."""
    c = start.copy()
    for _ in range(rounds):
        own = squares(x, c).argmin(1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = [int(s) // int((own == j).sum()) for s in x[own == j].sum(0)]
    d = squares(x, c)
    return d.argmin(1), d.min(1), c


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", "z", "k", 1) for i, v, label in rows], VECTORS)


def awkward(n=300, dims=64, seed=3):
    """Ties, repeated rows, nulls, other lengths, one vector for a third of all rows."""
    rng = np.random.default_rng(seed)
    own = [(i, (rng.integers(-3, 4, dims) / 64).tolist(), int(i % 3) if i % 5 else None) for i in range(n)]
    own += [(n + i, own[0][1], 7) for i in range(n // 2)] + [own[5], own[5], (None, own[7][1], None), (None, own[8][1], 1)]
    bad = [(10_000, None, 1), (10_001, own[0][1][:-1] + [None], 1), (10_002, own[0][1][:-1] + [float("nan")], 1), (10_003, own[0][1][:-1] + [float("inf")], None), (-1, [0.5] * (dims - 4), 1), (-2, [], 1), (-3, [0.5] * (dims - 1), 2)]
    return own, bad


def expected_clusters(rows, k=40, rounds=5, dims=64):
    kept = [(i, floors(v, 256)) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1].tolist()))[:k]
    x = np.array([v for _, v in kept])
    own, d, c = lloyd(x, np.array([v for _, v in first]), rounds)
    inertia = np.bincount(own, weights=d, minlength=len(c)).astype(int)
    return sorted(((i is None, i or 0), int(own[n]), int(d[n]), int(inertia[own[n]]), int(d.sum()), hashlib.sha256(",".join(map(str, c[own[n]].tolist())).encode()).hexdigest()) for n, (i, _) in enumerate(kept))


def clusters_of(df):
    return sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_clusters_on_the_whole_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    assert clusters_of(queries()["op11_clustering"](spark, sf)) == expected_clusters(rows)


def test_clusters_of_awkward_rows(spark):
    own, bad = awkward()
    df = frame(spark, own + bad).repartition(5)
    assert clusters_of(clustering.report(df)) == expected_clusters(own + bad)


def test_clusters_of_few_or_no_rows(spark):
    own, bad = awkward(n=9)
    assert clusters_of(clustering.report(frame(spark, own))) == expected_clusters(own)
    got = clustering.report(frame(spark, bad))
    assert got.count() == 0 and got.columns == clustering.report(frame(spark, own)).columns


def test_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-(1 << 23), 1 << 23, 64) / 256).astype(np.float32).tolist(), 1) for i in range(90)]
    assert clusters_of(clustering.report(frame(spark, rows))) == expected_clusters(rows)
    with pytest.raises(Exception, match="reaches"):
        clustering.report(frame(spark, [(1, [1e9] * 64, 1)])).collect()


def test_yinyang_bounds_hold_and_save_work():
    rng = np.random.default_rng(1)
    middle = rng.integers(-300, 300, (20, 64))
    x = np.concatenate([m + rng.integers(-20, 21, (100, 64)) for m in middle])
    c = x[rng.permutation(len(x))[:40]]
    group = clustering.grouped(c)
    assert set(range(group.max() + 1)) == set(group.tolist()) and 1 < group.max() + 1 <= 4
    n = len(x)
    own, upper, lower, moved = np.full(n, -1), np.zeros(n), np.zeros((n, group.max() + 1)), np.zeros(len(c))
    taken = []
    for _ in range(6):
        own, upper, lower, t = clustering.assigned(x, own, upper, lower, c, group, moved)
        d = squares(x, c)
        assert (own == d.argmin(1)).all() and (upper >= np.sqrt(d.min(1))).all()
        for g in range(group.max() + 1):
            others = np.where((group == g)[None] & (np.arange(len(c))[None] != own[:, None]), np.sqrt(d), np.inf)
            assert (lower[:, g] <= others.min(1) + 1e-6).all()
        taken.append(t)
        new = np.array([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
        moved, c = np.sqrt(((new - c) ** 2).sum(1)) * (1 + 1e-9), new
    assert taken[0] == n * len(c) and taken[-1] < taken[0] / 4


def expected_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, label, floors(v, 1024)) for i, v, label in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2].tolist()))
    x = np.array([v for *_, v in kept]).reshape(len(kept), parts, -1)
    per_part = [lloyd(x[:, p], x[:entries, p], rounds) for p in range(parts)]
    error = sum(d for _, d, _ in per_part)
    digest = hashlib.sha256(",".join(str(n) for *_, c in per_part for n in c.ravel().tolist()).encode()).hexdigest()
    by_label = defaultdict(int)
    for (_, label, _), e in zip(kept, error, strict=True):
        by_label[label] += int(e)
    return sorted(((i is None, i or 0), "".join(f"{int(own[n]):02x}" for own, *_ in per_part), int(error[n]), by_label[label], digest) for n, (i, label, _) in enumerate(kept))


def codes_of(df):
    return sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def test_codes_on_the_whole_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, sf, "embeddings").collect()]
    assert codes_of(queries()["op12_vector_codes"](spark, sf)) == expected_codes(rows)


def test_codes_of_awkward_rows(spark):
    own, bad = awkward(n=700)
    df = frame(spark, own + bad).repartition(5)
    assert codes_of(codes.report(df)) == expected_codes(own)


def test_codes_of_few_or_no_rows(spark):
    own, bad = awkward(n=9)
    assert codes_of(codes.report(frame(spark, own))) == expected_codes(own)
    got = codes.report(frame(spark, bad[:4]))
    assert got.count() == 0 and got.columns == codes.report(frame(spark, own)).columns


def test_label_errors_beyond_the_broadcast(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else i % 2, "00000000", i) for i in range(200)], "key bigint, label int, code string, error bigint")
    few, many = (sorted(map(tuple, codes.label_errors(rows, n).collect()), key=str) for n in (100, 1))
    assert few == many and len(many) == 200


def test_elkan_bounds_hold_and_save_work():
    rng = np.random.default_rng(2)
    middle = rng.integers(-400, 400, (60, 16))
    x = np.concatenate([m + rng.integers(-60, 61, (40, 16)) for m in middle])
    book = codes.Codebook(x[rng.permutation(len(x))[:256]])
    own, upper, lower = book.start(x)
    taken = []
    for _ in range(5):
        held = codes.unpack(codes.pack(lower, upper), upper, 256)
        d = np.sqrt(squares(x, book.entries))
        others = np.arange(256)[None] != own[:, None]
        assert (held <= d + 1e-3)[others].all() and (upper >= d.min(1)).all()
        new = np.array([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else book.entries[j] for j in range(256)])
        book = codes.Codebook(new, book.entries)
        own, upper, lower, t = book.round(x, own, upper, held)
        assert (own == squares(x, new).argmin(1)).all()
        taken.append(t)
    assert taken[-1] < len(x) * 256 / 10


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ROWS = [
    (1, "user = alice\nhost: db.example.com\npwd = hunter2"),  # three weak parts complete each other
    (2, "user = alice\n\npwd = hunter2"),  # another scope
    (3, "pwd = hunter2 and nothing else, host: db.example.com"),
    (4, "user=alice " + "x" * 200 + " pwd=hunter2"),  # 202 code points between them
    (5, "user=alice " + "x" * 198 + " pwd=hunter2"),
    (6, 'Token: "abc" secret=token: abcdefgh TOKEN=é api_key=\'Zz9/+_.=-\' apikey: 123456'),
    (7, "AKIA" + "A" * 15 + " AKIAAKIA" + "Z9" * 8 + " " + "f" * 23 + " " + "0a" * 12 + "g"),
    (8, "https://api.example.com/v1 token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
    (9, "https://api.example.com/24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),  # overlaps its only complement
    (10, "[a]\nuser = alice\n[b]\npwd = hunter2\nlogin: bob Bearer abcdefgh1"),
    (11, "日本 user: ユーザ client_id=é 😀 client_id = app-1 😀 Ab3" + "x" * 30 + " é"),
    (12, None),
    (13, ""),
    (None, "user = alice pwd = hunter2"),
    (None, "user = alice pwd = hunter2"),
    (14, "user = alice pwd = hunter2"),
    (15, "token=abcdef " * 3_000 + "user = alice " * 2_000 + "\n\n" * 500 + "user = bob"),
    (16, "a" * 60_000 + " token=" + "b" * 60_000 + " user=" + "c" * 1000),
]
DOCS = "doc_id bigint, text string, row bigint, kind int, start int, parts string, base string, key string"


def brute(text, reach=200):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    weak = [(m.start(), k, m.end()) for k in range(3, 7) for m in re.finditer(secrets.PATTERNS[secrets.KINDS[k]], text) if k != 5 or all(re.search(c, m[0]) for c in secrets.CLASSES)]
    ends = [m.start() for m in re.finditer(secrets.SCOPE_END, text)]
    scope = {s: sum(e < s[0] for e in ends) for s in {*base, *weak}} if weak else {}
    by_scope = defaultdict(list)
    for s, n in scope.items():
        by_scope[n].append(s)
    more = []
    for s in weak:
        near = {o[1] for o in by_scope[scope[s]] if 0 <= o[0] - s[2] <= reach or 0 <= s[0] - o[2] <= reach}
        ids, strong = near & {1, 3}, near & {0, 2}
        secret = strong | near & {4, 5}
        if {3: bool(secret), 6: bool(strong or secret and ids)}.get(s[1], bool(ids)):
            more.append(s)
    say = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*(sum(k == n for _, k, _ in base) for n in range(3)), len(more), hashlib.sha256(say(base).encode()).hexdigest(), say(base + more))


def secrets_of(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), tuple(r)[1:]) for r in df.collect())


def test_secrets_on_the_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    assert secrets_of(queries()["op13_secrets"](spark, sf)) == sorted(((i is None, i or 0), brute(t)) for i, t in rows)


def test_secrets_of_awkward_rows(spark):
    df = spark.createDataFrame([(i, t, 0, 0, 0, "x", "y", "z") for i, t in ROWS], DOCS).repartition(3)
    got = secrets_of(secrets.report(df))
    assert got == sorted(((i is None, i or 0), brute(t)) for i, t in ROWS)
    said = {i: v[-1] for (_, i), v in got}
    assert said[1] == "id:0:12,endpoint:13:33,pass:34:47" and said[2] == said[3] == said[4] == said[12] == said[13] == ""
    assert said[5].startswith("id:0:10,pass:") and said[9] == "hex:24:64" and said[8].startswith("endpoint:0:26,")
    assert said[10] == "pass:21:34,id:35:45,pass:46:62"
    assert secrets.report(df.limit(0)).count() == 0


def test_secrets_stay_in_the_jvm(spark, sf):
    plan = secrets.report(table(spark, sf, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_running_sums(spark):
    rows = [(list(range(n)),) for n in (0, 1, 63, 64, 65, 128, 1000)]
    got = spark.createDataFrame(rows, "a array<int>").select("a", secrets.running(F.col("a")).alias("s")).collect()
    assert all(r["s"] == np.cumsum(r["a"]).tolist() for r in got) and len(got) == len(rows)

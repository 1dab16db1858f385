"""Operators of the studies against plain versions and cases with known answers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import scalars as S
import __spark_entry__ as entry_module
from chronoloom.operators import graphs as G
from chronoloom.operators import leftout as O
from chronoloom.operators import metrics as M
from chronoloom.operators import phases as H
from chronoloom.operators import probes as P
from chronoloom.operators import scans as N
from chronoloom.operators import thresholds as T
from chronoloom.operators import twolevel as L
from chronoloom.plans.frames import read
from chronoloom.plans.policies import uncovered
from chronoloom.streaming import stateful


def windows_of(spark, nodes, edges, same):
    n = spark.createDataFrame(nodes, "gid bigint, window bigint, node bigint")
    pairs = "a bigint, b bigint"
    rows = G.reached_windows(n, spark.createDataFrame(edges, pairs), spark.createDataFrame(same, pairs)).collect()
    out = {}
    for r in rows:
        out.setdefault((r["gid"], r["window"]), {})[r["found"]] = r["hop"]
    return out


def test_windows_tied_by_one_entity(spark):
    """Six windows whose speakers are one: window 2 finds 0, 1, 3 and 4."""
    nodes = [(7, w, 10 * w + k) for w in range(6) for k in range(3)]
    local = [(10 * w, 10 * w + k) for w in range(6) for k in (1, 2)]
    same = [(10 * w, 10 * w + 10) for w in range(5)]
    assert windows_of(spark, nodes, local, same)[7, 2] == {0: 0, 1: 0, 3: 0, 4: 0}
    assert windows_of(spark, nodes, local, []) == {}
    assert windows_of(spark, [], [], []) == {}


def test_walks_against_every_path(spark):
    rng = np.random.default_rng(3)
    nodes = [(int(g), int(w), int(100 * g + 10 * w + k)) for g in range(2) for w in range(9) for k in range(3)]
    ids = {g: [n for h, _, n in nodes if h == g] for g in range(2)}
    draw = lambda n: [tuple(map(int, rng.choice(ids[g], 2, replace=False))) for g in range(2) for _ in range(n)]
    edges, same = draw(14), draw(5)
    found = windows_of(spark, nodes, edges, same)
    for g in range(2):
        far = {(a, b): 0 if a == b else 99 for a in ids[g] for b in ids[g]}
        for cost, pairs in ((1, edges), (0, same)):
            for a, b in pairs:
                if a in ids[g]:
                    far[a, b], far[b, a] = min(far[a, b], cost), min(far[b, a], cost)
        for k, a, b in itertools.product(ids[g], repeat=3):
            far[a, b] = min(far[a, b], far[a, k] + far[k, b])
        at = {n: w for h, w, n in nodes if h == g}
        for w in range(9):
            best = {}
            for a, b in itertools.product(ids[g], repeat=2):
                if at[a] == w != at[b] and far[a, b] <= 2:
                    best[at[b]] = min(best.get(at[b], 9), far[a, b])
            kept = sorted(v for v in best if v < w)[-2:] + sorted(v for v in best if v > w)[:2]
            assert found.get((g, w), {}) == {v: best[v] for v in kept}


@pytest.mark.parametrize("p", [[0.3], [0.9, 0.5, 0.1], [0.1, 0.5, 0.9], [0.4, 0.6, 0.5, 0.2, 0.3, 0.3, 0.7]])
def test_nonincreasing(spark, p):
    out = spark.range(1).select(S.nonincreasing(F.array(*map(F.lit, p))).alias("q")).first()["q"]
    blocks = []
    for x in p:
        blocks.append([x, 1])
        while len(blocks) > 1 and blocks[-2][0] < blocks[-1][0]:
            (a, n), (b, m) = blocks[-2:]
            blocks[-2:] = [[(a * n + b * m) / (n + m), n + m]]
    assert out == pytest.approx([v for v, n in blocks for _ in range(n)])


def test_ends(spark):
    rows = [(0.0, 5.0, None, None), (0.0, None, 4.0, 9.0), (0.0, None, None, 9.0), (2.0, None, None, None), (3.0, 3.0, None, None), (3.0, 1.0, 7.0, None), (float("nan"), 1.0, None, None)]
    df = spark.createDataFrame(rows, "s double, e double, f double, d double")
    got = df.select(S.filled_end(*map(F.col, "sefd")).alias("a"), S.widened_end(F.col("s"), F.col("e")).alias("b")).collect()
    assert [r["a"] for r in got[:6]] == [5.0, 4.0, 9.0, 32.0, None, None]
    assert [r["b"] for r in got] == [5.0, None, None, None, 4.0, 4.0, None]


def test_discovery_chain(spark):
    v = "HATEFUL_OR_OFFENSIVE"
    rows = [(1, v, [], "Irony"), (2, "NORMAL", [], "Irony"), (3, v, ["r"], "Irony"), (4, v, None, " OTHER: x "), (5, v, [], "none"), (6, v, [], None), (7, v, [], "Slur"), (8, v, [], "irony: a")]
    df = spark.createDataFrame(rows, "id int, verdict string, rules array<string>, mechanism string")
    assert {(r["id"], r["base"]) for r in uncovered(df, ["slur"]).collect()} == {(1, "irony"), (4, "other"), (8, "irony: a")}


def test_label_dims(spark):
    df = spark.createDataFrame([([1, 0, 0],), ([1, 1, 0],), ([0, 0, 1],), ([],), (None,), ([1, None, 0],)], "l array<int>")
    got = df.select(S.any_dim(F.col("l"), 1, 5).alias("a"), S.only_first(F.col("l")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, False), (True, False), (False, False), (False, False), (False, True)]


def series_frame(spark, rows):
    return spark.createDataFrame(rows, "gid bigint, y array<double>, level double")


def test_two_level_against_every_path(spark):
    """One step of the EM, with the states of positive series enumerated."""
    rng = np.random.default_rng(5)
    data = [(k, rng.normal(k % 2, 0.7, 1 + k % 4).tolist(), float(rng.normal(2 * (k % 2), 0.5))) for k in range(12)]
    stay = 0.8
    p0 = L.fit(series_frame(spark, data), stay, 1)
    p1 = L.fit(series_frame(spark, data), stay, 2)
    readings = np.sort(np.concatenate([y for _, y, _ in data]))
    levels = np.array([z for _, _, z in data])
    at = [readings[math.ceil(q * len(readings)) - 1] for q in (0.25, 0.75)]
    p = {"positive": 0.5, "start": 0.5, "negative": at[0], "off": at[0], "on": at[1], "variance": readings.var(), "level0": levels.mean() - levels.std(), "level1": levels.mean() + levels.std(), "level_variance": levels.var()}
    density = lambda x, m, v: math.exp(-((x - m) ** 2) / (2 * v)) / math.sqrt(2 * math.pi * v)
    total, w_of, readings_of, starts = 0.0, [], [], 0.0
    for _, y, z in data:
        paths = {}
        for path in itertools.product((0, 1), repeat=len(y)):
            chance = p["start"] if path[0] else 1 - p["start"]
            for a, b in zip(path, path[1:], strict=False):
                chance *= stay if a == b else 1 - stay
            paths[path] = chance * math.prod(density(x, p["on" if k else "off"], p["variance"]) for x, k in zip(y, path, strict=True))
        one = p["positive"] * sum(paths.values()) * density(z, p["level1"], p["level_variance"])
        none = (1 - p["positive"]) * math.prod(density(x, p["negative"], p["variance"]) for x in y) * density(z, p["level0"], p["level_variance"])
        total += math.log(one + none)
        w = one / (one + none)
        w_of.append(w)
        on = [w * sum(v for path, v in paths.items() if path[k]) / sum(paths.values()) for k in range(len(y))]
        starts += on[0]
        readings_of += [(x, 1 - w, w - o, o) for x, o in zip(y, on, strict=True)]
    assert p0["log_likelihood"] == pytest.approx(total)
    r, w = np.array(readings_of), np.array(w_of)
    means = [(r[:, 0] * r[:, k]).sum() / r[:, k].sum() for k in (1, 2, 3)]
    for name, value in zip(("negative", "off", "on"), means, strict=True):
        assert p0[name] == pytest.approx(value)
    assert p0["variance"] == pytest.approx(sum((r[:, k] * (r[:, 0] - m) ** 2).sum() for k, m in zip((1, 2, 3), means, strict=True)) / len(r))
    assert p0["positive"] == pytest.approx(w.mean()) and p0["start"] == pytest.approx(starts / w.sum())
    m1, m0 = (w * levels).sum() / w.sum(), ((1 - w) * levels).sum() / (1 - w).sum()
    assert p0["level_variance"] == pytest.approx((w * (levels - m1) ** 2 + (1 - w) * (levels - m0) ** 2).mean())
    assert p1["log_likelihood"] >= p0["log_likelihood"]


@pytest.mark.parametrize("cells", [1, 40, 250_000])
def test_two_level_series_side_by_side(monkeypatch, cells):
    """Series of unlike lengths, empty ones too, give the sums of each alone, in far fewer chains than series."""
    rng = np.random.default_rng(cells)
    series = [rng.normal(size=n % 23) for n in range(200)]
    level = rng.normal(size=200)
    p = {"positive": 0.3, "start": 0.2, "negative": -0.1, "off": 0.2, "on": 1.1, "variance": 0.8, "level0": -0.5, "level1": 0.7, "level_variance": 0.9}
    alone = sum(L._sums([y], level[k : k + 1], p, 0.8) for k, y in enumerate(series))
    chances = [L._expected([y], level[k : k + 1], p, 0.8)[1][0] for k, y in enumerate(series)]
    calls, own = [], L.chain_posteriors
    monkeypatch.setattr(L, "CELLS", cells)
    monkeypatch.setattr(L, "chain_posteriors", lambda e, *a: calls.append(e.shape) or own(e, *a))
    assert L._sums(series, level, p, 0.8) == pytest.approx(alone, abs=1e-9)
    assert sum(q for q, *_ in calls) == 200 and all(q == 1 or q * n <= max(cells, q) for q, n, _ in calls) and (cells < 1_000 or len(calls) == 1)
    for some in L._side_by_side(series):
        assert L._expected([series[k] for k in some], level[some], p, 0.8)[1] == pytest.approx([chances[k] for k in some], abs=1e-12)


def test_two_level_finds_the_positive_series(spark):
    rng = np.random.default_rng(1)
    data = []
    for k in range(60):
        on = np.repeat(rng.random(4) < 0.5, 5) * (k % 3 == 0)
        data.append((k, rng.normal(3.0 * on, 0.5).tolist(), float(k % 3 == 0) * 2 + rng.normal(0, 0.4)))
    df = series_frame(spark, [*data, (98, None, 1.0), (99, [1.0], None)])
    p = L.fit(df, 0.9, 20)
    w = {r["gid"]: r["w"] for r in L.positives(df, p, 0.9).collect()}
    assert w.pop(98) is None and w.pop(99) is None
    assert {k for k, v in w.items() if v > 0.5} == set(range(0, 60, 3))
    assert L.fit(df.where("gid < 0"), 0.9, 3) == {}


def test_mixture_is_the_best_of_its_starts(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 1, 120), rng.normal(4, 0.6, 60)]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    g = T.best_mixture(df, "x", 4, 25)

    def run(m):
        w, v = 0.5, [x.var() + 1e-4] * 2
        log = lambda: np.array([np.log(q) - 0.5 * np.log(2 * np.pi * s) - (x - a) ** 2 / (2 * s) for q, a, s in ((1 - w, m[0], v[0]), (w, m[1], v[1]))])
        for _ in range(25):
            r = np.exp(log()[1] - np.logaddexp.reduce(log()))
            w, m = r.mean(), [((1 - r) * x).sum() / (1 - r).sum(), (r * x).sum() / r.sum()]
            v = [((1 - r) * (x - m[0]) ** 2).sum() / (1 - r).sum(), (r * (x - m[1]) ** 2).sum() / r.sum()]
        return np.logaddexp.reduce(log()).sum(), w, m, v, np.exp(log()[1] - np.logaddexp.reduce(log()))

    likelihood, w, m, v, r = max((run(m) for m in T.mixture_starts(*np.quantile(x, [0.25, 0.75]), np.sqrt(x.var() + 1e-4), 4)), key=lambda f: f[0])
    assert [g[k] for k in ("weight", "mean0", "mean1", "var0", "var1", "log_likelihood")] == pytest.approx([w, *m, *v, likelihood], rel=1e-5)
    got = [q["p"] for q in df.select(T.high_posterior(F.col("x"), g).alias("p")).collect()]
    assert got == pytest.approx(r, abs=1e-6)
    assert T.best_mixture(df.where("x > 99"), "x") == {}


def test_folds_keep_shares(spark):
    df = spark.createDataFrame([(k, k % 4 == 0 if k % 9 else None) for k in range(900)], "id bigint, y boolean")
    counts = P.stratified_folds(df, "id", F.col("y"), 5).groupBy("fold", "y").count().collect()
    for y in (True, False):
        own = [r["count"] for r in counts if r["y"] == y]
        assert len(own) == 5 and max(own) - min(own) <= 1
    assert sum(r["count"] for r in counts) == 800


def test_evaluation_of_one_class(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (1, 0.2, 0), (2, 0.9, 1), (2, None, 0)], "gid int, s double, y int")
    e = M.evaluation(df, "s", "y", "gid", df.where("gid = 2")).first()
    assert (e["pooled_auc"], e["macro_auc"], e["defined"], e["skipped"]) == (1.0, None, 0, 1)
    assert M.evaluation(df, "s", "y", "gid").first()["macro_auc"] == 1.0
    assert M.paired_metric(df, "s", "s", "y", "gid").collect()[0]["delta"] == 0


def test_silent_keys_end(spark, tmp_path):
    """A key without rows for longer than the gap ends by the watermark that other keys move."""
    zero = 1_704_067_200_000
    hours = [(1, "a", 0.0), (1, "a", 1.0), (2, "b", 2.0), (2, "b", 90.0)]
    source = spark.createDataFrame(hours, "gid bigint, label string, t double").withColumn("ts", F.timestamp_millis((F.lit(zero) + F.col("t") * 3_600_000).cast("long")))
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    ended = stateful.drained(stateful.tracks(stream, 24.0, 9, delay="1 hour", zero_ms=zero), "silent", str(tmp_path)).collect()
    assert {(r["gid"], r["start"], r["end"], r["n"], r["reason"]) for r in ended} == {(1, 0.0, 1.0, 2, "gap"), (2, 2.0, 2.0, 1, "gap")}


def brute_step(lists, p):
    """Sums of an E-step by all paths of all kinds."""
    import itertools
    import math

    normal = lambda x, m, v: -0.5 * math.log(2 * math.pi * v) - (x - m) ** 2 / (2 * v)
    kinds = list(lists)
    out = np.zeros(3 + 15 * len(kinds))
    for r in range(len(lists[kinds[0]])):
        negative, chains = math.log(1 - p["positive"]), {}
        for name in kinds:
            y, k = lists[name][r], p["kinds"][name]
            negative += sum(normal(x, k["negative"], k["variance"]) for x in y)
            start = (1 - k["start"], k["start"])
            chains[name] = {path: sum(math.log(start[s]) if t == 0 else math.log(k["step"][path[t - 1]][s]) for t, s in enumerate(path)) + sum(normal(x, k[("off", "on")[s]], k["variance"]) for x, s in zip(y, path, strict=True)) for path in itertools.product((0, 1), repeat=len(y))}
        evidence = {name: math.log(sum(map(math.exp, own.values()))) for name, own in chains.items()}
        positive = math.log(p["positive"]) + sum(evidence.values())
        total = math.log(math.exp(negative) + math.exp(positive))
        w = math.exp(positive - total)
        out[:3] += [total, 1, w]
        for i, name in enumerate(kinds):
            own, y = out[3 + 15 * i : 18 + 15 * i], lists[name][r]
            own[6:9] += [(1 - w) * sum(x**k for x in y) for k in range(3)]
            for path, log in chains[name].items():
                q = w * math.exp(log - evidence[name])
                for t, s in enumerate(path):
                    own[9 + 3 * s : 12 + 3 * s] += [q, q * y[t], q * y[t] ** 2]
                    if t:
                        own[2 + 2 * path[t - 1] + s] += q
                    else:
                        own[s] += q
    return out


def test_tied_chains_by_enumeration():
    from chronoloom.operators import tiedchains as C

    rng = np.random.default_rng(2)
    lists = {k: [rng.normal(0, 1, n).tolist() for n in (3, 1, 0, 5)] for k in ("a", "b")}
    lists["b"][0] = []
    p = {"positive": 0.3, "kinds": {"a": {"start": 0.4, "step": [[0.7, 0.3], [0.4, 0.6]], "negative": -0.2, "off": -0.5, "on": 0.9, "variance": 0.8}, "b": {"start": 0.1, "step": [[0.9, 0.1], [0.5, 0.5]], "negative": 0.1, "off": -1.0, "on": 0.2, "variance": 1.5}}}
    assert C.sums(lists, p) == pytest.approx(brute_step(lists, p))
    before = -np.inf
    for _ in range(8):  # the likelihood never falls
        s = C.sums(lists, p)
        assert s[0] >= before - 1e-9
        before, p = s[0], C.updated(s, ["a", "b"])


def test_tied_chains_query(spark, sf):
    """Plain rounds over all series at once give the query's chances."""
    import __spark_entry__ as entry_module
    from chronoloom.operators import tiedchains as C
    from chronoloom.plans.frames import curve

    kinds = ["click", "error", "purchase", "signup", "view"]
    by = {}
    for r in sorted(curve(spark, sf).collect(), key=lambda r: (r["gid"], r["idx"])):
        by.setdefault(r["gid"], {k: [] for k in kinds})[r["event_type"]].append(float(np.log1p(r["s"])))
    series = spark.createDataFrame([(g, *[v[k] for k in kinds]) for g, v in by.items()], "gid bigint, " + ", ".join(f"{k} array<double>" for k in kinds))
    p, likelihoods = C.fit(series, kinds, 6)
    assert all(b >= a - 1e-6 for a, b in zip(likelihoods, likelihoods[1:], strict=False))
    w = dict(zip(by, C.expected({k: [v[k] for v in by.values()] for k in kinds}, p)[1], strict=True))
    rows = {r["gid"]: r["w"] for r in entry_module.queries()["q_tied_chains"](spark, sf).collect()}
    assert rows == {g: pytest.approx(x, abs=2e-5) for g, x in w.items()}


def refitted(x, y, ridge):
    """Log odds of each row by a fit of all others, one by one."""
    z, penalty = np.column_stack([np.ones(len(x)), x]), ridge * np.diag(np.r_[0.0, np.ones(x.shape[1])])

    def loss(a, t, b):
        return np.logaddexp(0, a @ b).sum() - t @ (a @ b) + b @ penalty @ b / 2

    out = []
    for k in range(len(x)):
        a, t, b = np.delete(z, k, axis=0), np.delete(y, k), np.zeros(z.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -700, 700)))
            step = np.linalg.solve((a.T * (p * (1 - p))) @ a + penalty, a.T @ (t - p) - penalty @ b)
            while loss(a, t, b + step) > loss(a, t, b) + 1e-9:
                step /= 2
            b = b + step
            if np.abs(step).max() < 1e-12:
                break
        out.append(z[k] @ b)
    return np.array(out)


def test_logistic_leave_one_out(spark, sf):
    e = sorted(read(spark, sf, "embeddings").collect(), key=lambda r: r["vec_id"])
    x, y = np.array([r["embedding"] for r in e], float), np.array([float(r["label"] == 0) for r in e])
    found = {r["vec_id"]: r["score"] for r in entry_module.queries()["q_logistic_leave_one_out"](spark, sf).collect()}
    assert [found[r["vec_id"]] for r in e] == pytest.approx(refitted(x, y, 1.0), abs=6e-6) and len(found) == len(e)


@pytest.mark.parametrize("seed,n,d,scale,ridge", [(1, 40, 2, 1.0, 1.0), (2, 30, 3, 30.0, 0.01), (3, 60, 1, 5.0, 0.1)])
def test_left_out_rows_that_move_the_fit_far(spark, monkeypatch, seed, n, d, scale, ridge):
    """Few rows, wide values and a weak penalty; several chunks and blocks."""
    monkeypatch.setattr(O, "CHUNK", 16)
    monkeypatch.setattr(O, "BLOCK", 9)
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * scale
    y = (x[:, 0] / scale + r.normal(size=n) > 0).astype(float)
    df = spark.createDataFrame([(int(k), v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))], "k int, v array<double>, y double")
    found = {r["k"]: r["score"] for r in O.logistic_leave_one_out(df, "k", "v", F.col("y"), ridge).collect()}
    assert [found[k] for k in range(n)] == pytest.approx(refitted(x, y, ridge), abs=1e-5)


def test_one_step_is_enough_for_many_rows(spark):
    """The bound closes rows after the first step, and they are right to the tolerance."""
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 2))
    y = (x[:, 0] + 2 * r.normal(size=4000) > 0).astype(float)
    df = spark.createDataFrame([(k, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))], "k int, v array<double>, y double")
    loose, tight = ({r["k"]: r["score"] for r in O.logistic_leave_one_out(df, "k", "v", F.col("y"), 1.0, tolerance=t).collect()} for t in (1e-4, 1e-10))
    assert max(abs(loose[k] - tight[k]) for k in range(4000)) < 1e-4


def test_left_out_rows_without_vector_class_or_others(spark):
    rows = [(1, [0.0], 1.0), (1, [1.0], 0.0), (1, [1.0], 0.0), (2, None, 1.0), (3, [2.0], None)]
    df = spark.createDataFrame(rows, "k int, v array<double>, y double")
    found = sorted(((r["k"], r["y"], r["score"]) for r in O.logistic_leave_one_out(df, "k", "v", F.col("y"), 1.0).collect()), key=str)
    want = refitted(np.array([[0.0], [1.0], [1.0]]), np.array([1.0, 0.0, 0.0]), 1.0)[1]
    assert [f[:2] for f in found] == [(1, 0.0), (1, 0.0), (1, 1.0), (2, 1.0), (3, None)]
    assert [f[2] for f in found[:2]] == pytest.approx([want, want], abs=1e-6) and [f[2] for f in found[2:]] == [None] * 3
    for few in (rows[:0], rows[:2], rows[1:3]):
        own = O.logistic_leave_one_out(spark.createDataFrame(few, "k int, v array<double>, y double"), "k", "v", F.col("y"), 1.0).collect()
        assert [r["score"] for r in own] == [None] * len(few)


def phase_chances(kind, k, cell, length, start, values, pair, means, sd, independent=False):
    """Chances of the phases at each cell, summed over all paths of (phase, sub-state); a reading of two cells looks at the path's phase before."""
    phases = range(len(kind.positive))
    k = 1 if independent else k
    states = [(p, i) for p in phases for i in range(k)]

    def step(a, b):
        if independent:
            return start[b[0]]
        leave = min(max(k * cell / length[kind.positive[a[0]]], 1e-9), 1.0)
        chance = 1 - leave if a == b else 0.0
        if b == (a[0], a[1] + 1):
            chance += leave
        if a[1] == k - 1 and b[1] == 0:
            chance += leave * kind.onward[a[0]][b[0]]
        return chance

    total = np.zeros((len(values), len(phases)))
    for path in itertools.product(states, repeat=len(values)):
        chance = start[path[0][0]] / k
        for a, b in itertools.pairwise(path):
            chance *= step(a, b)
        for t, (p, _) in enumerate(path):
            before = path[t - 1][0] if t else 0
            for c, own in enumerate(kind.levels):
                level = max(own[p], own[before]) if pair[t] else own[p]
                if chance and not math.isnan(values[t][c]):
                    chance *= math.exp(-0.5 * ((values[t][c] - means[c][level]) / sd) ** 2)
        for t, (p, _) in enumerate(path):
            total[t, p] += chance
    return total / total.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("name,k,independent", [("two", 3, False), ("two", 2, True), ("three_nested", 2, False), ("three_free", 1, False), ("joint", 1, False)])
def test_chains_of_phases_against_all_paths(spark, name, k, independent):
    kind, r = H.KINDS[name], np.random.default_rng(len(name) + k)
    n, columns = 5, len(kind.levels)
    start = r.dirichlet(np.ones(len(kind.positive)))
    means = [list(np.arange(max(own) + 1) * 1.5) for own in kind.levels]
    series = {g: (np.where(r.random((n, columns)) < 0.2, np.nan, r.normal(1, 1, (n, columns))), r.integers(0, 2, n)) for g in (1, 2)}
    rows = [(g, t, n, *map(float, v[t]), int(pair[t])) for g, (v, pair) in series.items() for t in range(n)]
    names = [f"v{c}" for c in range(columns)]
    df = spark.createDataFrame(rows, "gid bigint, idx bigint, n bigint, " + ", ".join(f"{c} double" for c in names) + ", pair int")
    for kept in (True, False):
        chain = H.phase_chain(kind, k, 1.0, (5.0, 3.0), start, keep_before=kept, independent=independent)
        assert np.allclose(chain.transition.sum(axis=1), 1) and chain.start.sum() == pytest.approx(1)
        own = names + ["pair"] * kept
        found = {(x["gid"], x["idx"]): np.bincount(chain.phase, x["p"], len(kind.positive)) for x in N.posteriors(df, own, H.readings(chain, means, 1.0)).collect()}
        for g, (v, pair) in series.items():
            want = phase_chances(kind, k, 1.0, (5.0, 3.0), start, v, pair * kept, means, 1.0, independent)
            assert np.allclose([found[g, t] for t in range(n)], want, atol=1e-9)


def test_two_phases_from_one_chance_and_lengths_out_of_range():
    one = H.phase_chain(H.KINDS["two"], 2, 4.0, (1.0, 1e30), 0.3, keep_before=False)
    assert one.start.tolist() == pytest.approx([0.35, 0.35, 0.15, 0.15])
    assert one.transition[0].tolist() == [0, 1, 0, 0] and one.transition[1].tolist() == [0, 0, 1, 0] and one.transition[2, 2] == 1 - 1e-9


def forward_backward_of(chain, logs):
    a = [chain.start * np.exp(logs[0])]
    for e in logs[1:]:
        a.append(a[-1] / a[-1].sum() @ chain.transition * np.exp(e))
    z, out = np.ones(len(chain.start)), []
    for t in reversed(range(len(logs))):
        p = a[t] * z
        out.append(p / p.sum())
        z = chain.transition @ (z * np.exp(logs[t]))
        z /= z.sum()
    return np.array(out[::-1])


@pytest.mark.parametrize("name", ["q_nested_phases", "q_joint_phases"])
def test_queries_on_phases(spark, sf, name):
    """Whole series of the table, long ones among them, by plain recursions."""
    series = {}
    for r in read(spark, sf, "events").orderBy("ts", "event_id").collect():
        series.setdefault(r["user_id"], []).append(r)
    found = {(r["gid"], r["idx"]): tuple(r)[2:] for r in entry_module.queries()[name](spark, sf).collect()}
    assert len(found) == sum(map(len, series.values()))
    nested = name == "q_nested_phases"
    kind = H.KINDS["three_nested" if nested else "joint"]
    chain = H.phase_chain(kind, 2, 1.0, (6.0, 4.0), np.array([0.5, 0.3, 0.2])) if nested else H.phase_chain(kind, 1, 1.0, (8.0, 3.0), np.array([0.7, 0.1, 0.1, 0.1]), keep_before=False)
    for g in sorted(series)[::5]:
        logs = []
        for r in series[g]:
            if nested:
                level = [max(p, b) if r["event_type"] == "purchase" else p for p, b in zip(chain.phase, chain.before, strict=True)]
                logs.append([-0.5 * ((r["value"] - (20.0, 60.0, 120.0)[q]) / 40) ** 2 for q in level])
            else:
                second = r["event_type"] in ("click", "view")
                logs.append([-0.5 * ((r["value"] - (30.0, 90.0)[p // 2]) / 45) ** 2 - second * 0.5 * ((r["value"] - (20.0, 110.0)[p % 2]) / 45) ** 2 for p in range(4)])
        want = forward_backward_of(chain, np.array(logs) - np.max(logs, axis=1, keepdims=True))
        for t, p in enumerate(want):
            by = np.bincount(chain.phase, p, len(kind.positive))
            assert found[g, t] == pytest.approx((by[1], by[2]) if nested else (1 - by[0],), abs=2e-7)

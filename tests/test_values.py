"""Queries without SQL against plain Python versions, on the smallest tables."""

import gzip
import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry_module
from chronoloom.plans.frames import curve, read, spans

QUERIES = entry_module.queries()


@pytest.fixture(scope="module")
def series(spark, sf):
    """Rows of each series in order: t, s, y, event_type."""
    out = defaultdict(list)
    for r in sorted(curve(spark, sf).collect(), key=lambda r: (r["gid"], r["idx"])):
        out[r["gid"]].append(r)
    return dict(out)


@pytest.fixture(scope="module")
def rows(spark, sf):
    return lambda name: [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def scores(own):
    return np.array([r["s"] for r in own])


def by_position(found, value):
    return {(r["gid"], r["idx"]): r[value] for r in found}


def emissions(s):
    z = (s - 50) / 20
    return np.column_stack([-0.5 * (z + 0.7) ** 2, -0.5 * (z - 0.7) ** 2])


def logsum(x):
    return np.logaddexp.reduce(x)


def test_model_averaged_posterior(series, rows):
    found = by_position(rows("q_model_averaged_posterior"), "p1")
    assert len(found) == sum(map(len, series.values()))
    for gid, own in series.items():
        e, n = emissions(scores(own)), len(own)
        lengths = [2.0] if n <= 2 else [2 * (n / 2) ** (k / 4) for k in range(5)]
        evidence, posterior = [], []
        for length in lengths:
            step = np.log([[1 - 1 / length, 1 / length], [1 / length, 1 - 1 / length]])
            ahead = [np.log([0.5, 0.5]) + e[0]]
            for i in range(1, n):
                ahead.append(np.array([logsum(ahead[-1] + step[:, j]) for j in range(2)]) + e[i])
            back = [np.zeros(2)]
            for i in range(n - 1, 0, -1):
                back.append(np.array([logsum(step[j] + e[i] + back[-1]) for j in range(2)]))
            both = np.array(ahead) + np.array(back[::-1])
            evidence.append(logsum(ahead[-1]))
            posterior.append(np.exp(both[:, 1] - evidence[-1]))
        w = np.exp(np.array(evidence) - logsum(evidence))
        for k, p in enumerate(w @ np.array(posterior)):
            assert found[gid, k] == pytest.approx(p, abs=1e-6)


def test_phase_path(series, rows):
    found = by_position(rows("q_phase_path"), "phase")
    for gid, own in series.items():
        z = (scores(own) - 50) / 20
        score = np.column_stack([-z * z, z, -np.abs(z - 0.5)])
        step = np.array([[1 / 3, 1 / 3, 1 / 3], [0, 1 / 2, 1 / 2], [0, 0, 1]])
        best = math.log(1 / 3) + score[0]
        for x in score[1:]:
            best = np.array([max(best[i] + math.log(step[i, j]) for i in range(3) if step[i, j]) for j in range(3)]) + x
        path = [found[gid, k] for k in range(len(own))]
        worth = math.log(1 / 3) + sum(score[k, p] for k, p in enumerate(path)) + sum(math.log(step[a, b]) for a, b in zip(path, path[1:], strict=False))
        assert worth == pytest.approx(best.max())


def test_dtw(series, rows):
    found = {r["gid"]: r for r in rows("q_dtw")}
    for gid, own in series.items():
        s = scores(own)
        a, b = s[: len(s) // 2], s[len(s) // 2 :]
        least = {}
        for i in range(len(a)):
            for j in range(len(b)):
                before = [least[x] for x in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x in least]
                least[i, j] = abs(a[i] - b[j]) + (min(before) if before else 0)
        assert found[gid]["cost"] == pytest.approx(least.get((len(a) - 1, len(b) - 1), 0.0), abs=1e-5)
        assert not len(a) or max(len(a), len(b)) <= found[gid]["steps"] < len(a) + len(b)


def test_change_boundaries(series, rows):
    found = defaultdict(set)
    for r in rows("q_change_boundaries"):
        found[r["gid"]].add(r["boundary"])
    for gid, own in series.items():
        s = scores(own)
        change = np.abs(np.diff(s, prepend=s[0]))
        n = len(s)
        smooth = change.copy()
        if n >= 5:
            for i in range(n):
                at = min(max(i - 2, 0), n - 5)
                smooth[i] = np.polyval(np.polyfit(np.arange(5.0), change[at : at + 5], 2), i - at)
        before = np.array([smooth[max(0, i - 6) : i].mean() if i else smooth[0] for i in range(n)])
        ratio = smooth / np.maximum(np.abs(before), 1e-9)
        limit = np.median(ratio) + 2 * 1.4826 * np.median(np.abs(ratio - np.median(ratio)))
        hit = [i for i in range(n) if ratio[i] > limit]
        assert found[gid] == {i for i, j in zip(hit, [*hit[1:], n + 9], strict=True) if j - i >= 3}


def test_mdl_segments(series, rows):
    found = defaultdict(list)
    for r in rows("q_mdl_segments"):
        found[r["gid"]].append(r["start"])
    for gid, own in series.items():
        s = scores(own)
        penalty = 2 * math.log(len(s)) * max(s.var(), 1e-9)
        best = [0.0]
        for j in range(1, len(s) + 1):
            best.append(min(best[i] + s[i:j].var() * (j - i) + penalty for i in range(j)))
        starts = sorted(found[gid])
        assert starts[0] == 0
        assert sum(((p - p.mean()) ** 2).sum() + penalty for p in np.split(s, starts[1:])) == pytest.approx(best[-1])


def test_mean_transport(series, rows):
    found = by_position(rows("q_mean_transport"), "v")
    every = np.concatenate([scores(own) for own in series.values()])
    low, high = every.min(), every.max()
    for gid, own in series.items():
        v = np.array([found[gid, k] for k in range(len(own))])
        p, y = (scores(own) - low) / (high - low), np.array([float(r["y"]) for r in own])
        assert v.mean() == pytest.approx(p.mean(), abs=1e-4)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        moved = np.log(v / (1 - v)) - np.log(p / (1 - p))
        inner = (v > 0.01) & (v < 0.99) & (p > 0.01) & (p < 0.99)  # rounding to six digits moves the odds at the ends
        for side in (0, 1):
            some = moved[inner & (y == side)]
            assert not len(some) or np.ptp(some) < 1e-3  # all rows of one label are shifted alike


def unit(x):
    c = x - np.median(x)
    mad = 1.4826 * np.median(np.abs(c))
    scale = mad if mad > 1e-12 else math.sqrt((c * c).mean())
    return c / scale if scale > 1e-12 else c * 0


def test_time_residual(series, rows):
    found = by_position(rows("q_time_residual"), "v")
    for gid, own in series.items():
        n = len(own)
        if n < 8:
            continue
        t = np.linspace(-1, 1, n)
        x = np.column_stack([np.ones(n), unit(np.array([float(r["y"]) for r in own])), unit(np.array([float(r["event_type"] == "view") for r in own])), t, t * t])
        left = unit(unit(scores(own)) - x @ np.linalg.lstsq(x, unit(scores(own)), rcond=1e-10)[0])
        assert np.allclose([found[gid, k] for k in range(n)], left, atol=1e-4)


def test_barycentre(series, rows):
    found = by_position(rows("q_barycentre"), "v")
    for gid, own in series.items():
        n, s, y = len(own), scores(own), np.array([float(r["y"]) for r in own])
        v = np.array([found[gid, k] for k in range(n)])
        assert v.sum() == pytest.approx(1, abs=1e-6) and (v >= 0).all()
        middle = lambda m: (m / m.sum()) @ np.arange(n)
        # the mean of the mass halfway is halfway between the means, but for the grid and the ends of the smoothing
        assert abs(middle(v) - (middle(s) + middle(s[::-1] + y)) / 2) < 1.0


def test_haar_denoise(series, rows):
    found = by_position(rows("q_haar_denoise"), "v")
    for gid, own in series.items():
        x, n = scores(own), len(own)
        if n < 4:
            continue
        whole = np.pad(x, (0, (1 << (n - 1).bit_length()) - n), mode="reflect")
        size = len(whole)
        basis, width = [np.full(size, size**-0.5)], 2
        while width <= size:
            for k in range(0, size, width):
                v = np.zeros(size)
                v[k : k + width // 2], v[k + width // 2 : k + width] = width**-0.5, -(width**-0.5)
                basis.append(v)
            width *= 2
        c = np.array(basis) @ whole
        fine = c[1 : 1 + size // 2]
        limit = np.median(np.abs(fine - np.median(fine))) / 0.6744897501960817 * math.sqrt(2 * math.log(n))
        c[1:] = np.sign(c[1:]) * np.maximum(np.abs(c[1:]) - limit, 0)
        smooth = (np.array(basis).T @ c)[:n]
        assert np.allclose([found[gid, k] for k in range(n)], smooth - smooth.mean() + x.mean(), atol=1e-5)


def test_sure_threshold(series, rows):
    found = {r["gid"]: r["threshold"] for r in rows("q_sure_threshold")}
    for gid, own in series.items():
        s = scores(own)
        d = np.array([(a - b) / math.sqrt(2) for a, b in zip(s[::2], s[1::2], strict=False)])
        sigma = np.median(np.abs(d)) / 0.6745
        x = np.abs(d) / sigma
        risk = lambda t: len(x) - 2 * (x <= t + 1e-9).sum() + np.minimum(x, t).dot(np.minimum(x, t))  # noqa: B023, E731
        top = math.sqrt(2 * math.log(len(x)))
        grid = np.concatenate([np.linspace(0, top, 400), x[x <= top]])
        assert found[gid] / sigma <= top + 1e-6 and risk(found[gid] / sigma + 1e-6) <= min(map(risk, grid)) + 1e-3


def test_gap_filled_peaks(series, rows):
    found = defaultdict(list)
    for r in rows("q_gap_filled_peaks"):
        found[r["gid"]].append(r["boundary"])
    for gid, own in series.items():
        s, n = scores(own), len(own)
        peaks = {i for i in range(1, n - 1) if s[i - 1] <= s[i] > s[i + 1]}
        b = sorted(found[gid])
        assert b[0] == 0 and all(y - x <= 9 for x, y in zip(b, [*b[1:], n], strict=True))
        for x, y in zip(b, b[1:], strict=False):
            assert y in peaks and y - x >= 4 or y - x == 9
            # no peak that is far enough was passed over, unless a gap had to be filled before it
            assert not any(x + 4 <= p < y for p in peaks)


def test_pairwise_scores(series, rows):
    found = {(r["gid"], r["event_type"]): r["v"] for r in rows("q_pairwise_scores")}
    for gid, own in series.items():
        kinds = sorted({r["event_type"] for r in own})
        pairs = [(kinds.index(b["event_type"]), kinds.index(a["event_type"]), b["s"] - a["s"]) for a, b in zip(own, own[1:], strict=False) if a["event_type"] != b["event_type"]]
        x = np.zeros((len(pairs) + 1, len(kinds)))
        for k, (i, j, _) in enumerate(pairs):
            x[k, i], x[k, j] = 1, -1
        x[-1] = 1  # the mean is zero
        fit = np.linalg.lstsq(x, np.array([d for *_, d in pairs] + [0.0]), rcond=None)[0]
        assert np.allclose([found[gid, k] for k in kinds], fit, atol=1e-4)


def test_greedy_interval_f1(spark, sf, series, rows):
    gold, hit, n_pred, n_gold = defaultdict(list), 0, 0, 0
    for r in spans(spark, sf).collect():
        gold[r["gid"]].append((r["start"], r["end"]))
    for gid, own in series.items():
        runs, last = [], None
        for k, r in enumerate(own):
            if r["s"] >= 60:
                runs = [*runs[:-1], (runs[-1][0], r["t"] + 1)] if last == k - 1 and runs else [*runs, (r["t"], r["t"] + 1)]
                last = k
        left, right = set(range(len(runs))), set(range(len(gold[gid])))
        n_pred, n_gold = n_pred + len(left), n_gold + len(right)
        shares = {(i, j): max(0, min(runs[i][1], gold[gid][j][1]) - max(runs[i][0], gold[gid][j][0])) / (max(runs[i][1], gold[gid][j][1]) - min(runs[i][0], gold[gid][j][0])) for i in left for j in right}
        while pairs := [(v, i, j) for (i, j), v in shares.items() if v >= 0.1 and i in left and j in right]:
            _, i, j = max(pairs)
            left.remove(i)
            right.remove(j)
            hit += 1
    r = rows("q_greedy_interval_f1")[0]
    assert (r["hit"], r["n_pred"], r["n_gold"]) == (hit, n_pred, n_gold)
    assert r["f1"] == pytest.approx(2 * hit / (n_pred + n_gold), abs=1e-8) and r["precision"] == pytest.approx(hit / n_pred, abs=1e-8)


def test_nearest_score_pairs(series, rows):
    found = defaultdict(set)
    for r in rows("q_nearest_score_pairs"):
        found[r["gid"]].add((r["a"], r["b"]))
    for gid, own in series.items():
        a, b = ([k for k, r in enumerate(own) if r["y"] == y] for y in (1, 0))
        pairs = set()
        while a and b:
            i, j = min(((i, j) for i in a for j in b), key=lambda p: (abs(own[p[0]]["s"] - own[p[1]]["s"]), p))
            a.remove(i)
            b.remove(j)
            pairs.add((i, j))
        assert found[gid] == pairs


def test_compression_ratio(spark, sf, rows):
    found = {r["doc_id"]: r["ratio"] for r in rows("q_compression_ratio")}
    for r in read(spark, sf, "documents").collect():
        raw = (r["text"] or "").encode()
        assert not raw and found[r["doc_id"]] is None or found[r["doc_id"]] == pytest.approx(len(raw) / len(gzip.compress(raw)), abs=1e-8)


def test_clause_keys(spark, sf, rows):
    found = {r["item_id"]: r["k"] for r in rows("q_clause_keys")}
    for r in read(spark, sf, "benchmark").collect():
        plain = "".join(c if c == "_" or c.isalnum() or c.isspace() else " " for c in unicodedata.normalize("NFKC", r["text"]).casefold())
        assert found[r["item_id"]] == " ".join(plain.split())


def test_collapse_repeats(spark, sf, rows):
    found = {r["doc_id"]: r["n"] for r in rows("q_collapse_repeats")}
    own = [r for r in read(spark, sf, "documents").collect() if len(r["text"] or "") < 3000]
    assert own

    def repeated(w):
        return next(((i, n) for n in range(4, 0, -1) for i in range(len(w) - 2 * n + 1) if w[i : i + n] == w[i + n : i + 2 * n]), None)

    for r in own:
        w = (r["text"] or "").split()
        least = len(w)
        while at := repeated(w):
            del w[at[0] : at[0] + at[1]]
        # the order of steps may leave another text, but none with a repetition, and one only where there was one
        assert (found[r["doc_id"]] < max(least, 1)) == (len(w) < least) or not w


def test_text_valleys(spark, sf, rows):
    found = {r["doc_id"]: r["breaks"] for r in rows("q_text_valleys")}
    for r in read(spark, sf, "documents").collect():
        w = (r["text"] or "").lower().split()
        at = range(20, len(w) - 19, 10)
        cos = []
        for k in at:
            a, b = Counter(w[k - 20 : k]), Counter(w[k : k + 20])
            cos.append(round(sum(a[x] * b[x] for x in a) / math.sqrt(sum(x * x for x in a.values())) / math.sqrt(sum(x * x for x in b.values())), 12))
        kept = []
        if len(cos) > 2:
            limit = np.mean(cos) - np.std(cos) / 2
            for c, k in sorted((c, k) for c, k, left, right in zip(cos[1:-1], at[1:-1], cos, cos[2:], strict=False) if c <= min(left, right) and c < limit):
                if all(abs(k - x) >= 30 for x in kept):
                    kept.append(k)
        assert found[r["doc_id"]] == ",".join(map(str, sorted(kept)))


def test_dawid_skene(series, rows):
    votes = {gid: {k: float(np.mean([r["s"] for r in own if r["event_type"] == k]) > 50) for k in {r["event_type"] for r in own}} for gid, own in series.items()}
    judges = sorted({k for v in votes.values() for k in v})
    pi, sens, spec = 0.5, dict.fromkeys(judges, 0.7), dict.fromkeys(judges, 0.7)
    safe = lambda p: min(max(p, 1e-3), 1 - 1e-3)
    for _ in range(15):
        r = {}
        for gid, v in votes.items():
            one = safe(pi) * math.prod(sens[k] if x else 1 - sens[k] for k, x in v.items())
            zero = (1 - safe(pi)) * math.prod(1 - spec[k] if x else spec[k] for k, x in v.items())
            r[gid] = one / (one + zero)
        pi = sum(r.values()) / len(r)
        for k in judges:
            own = [(r[g], v[k]) for g, v in votes.items() if k in v]
            sens[k] = safe(sum(p * x for p, x in own) / max(sum(p for p, _ in own), 1e-9))
            spec[k] = safe(sum((1 - p) * (1 - x) for p, x in own) / max(sum(1 - p for p, _ in own), 1e-9))
    for r in rows("q_dawid_skene"):
        assert (r["sensitivity"], r["specificity"]) == (pytest.approx(sens[r["judge"]], abs=2e-5), pytest.approx(spec[r["judge"]], abs=2e-5))


def test_logistic_fit_is_where_the_gradient_vanishes(series, rows):
    b = np.array([r["value"] for r in sorted(rows("q_logistic_fit"), key=lambda r: r["name"])])
    x = np.array([[1, r["s"] / 100, r["t"] / 700] for own in series.values() for r in own])
    y = np.array([r["y"] for own in series.values() for r in own])
    gradient = x.T @ (y - 1 / (1 + np.exp(-x @ b))) - np.array([0, b[1], b[2]])
    assert np.abs(gradient).max() < 1e-2


def vectors(spark, sf):
    own = sorted(read(spark, sf, "embeddings").collect(), key=lambda r: r["vec_id"])
    return np.array([r["vec_id"] for r in own]), np.array([r["embedding"] for r in own], float), np.array([r["label"] for r in own])


def test_principal_axes(spark, sf, rows):
    _, x, _ = vectors(spark, sf)
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert [r["value"] for r in sorted(rows("q_principal_axes"), key=lambda r: r["name"])] == pytest.approx((values / values.sum())[:5].tolist(), abs=1e-5)


def test_ridge_probe(spark, sf, rows):
    from pyspark.sql import functions as F

    ids, x, label = vectors(spark, sf)
    folds = {r["vec_id"]: r["f"] for r in read(spark, sf, "embeddings").select("vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(5)).alias("f")).collect()}
    fold = np.array([folds[i] for i in ids])
    y, score = (label == 0).astype(float), np.zeros(len(ids))
    for f in range(5):
        a = np.column_stack([np.ones((fold != f).sum()), x[fold != f]])
        b = np.linalg.lstsq(np.vstack([a, np.column_stack([np.zeros(64), np.eye(64)])]), np.concatenate([y[fold != f], np.zeros(64)]), rcond=None)[0]
        score[fold == f] = b[0] + x[fold == f] @ b[1:]
    won = [(p > n) + 0.5 * (p == n) for p in score[y == 1] for n in score[y == 0]]
    assert rows("q_ridge_probe")[0]["auc"] == pytest.approx(np.mean(won), abs=1e-4)


def test_mixtures_are_fixed_points_of_their_steps(series, rows):
    """Plain EM of the same start and number of steps."""
    s = np.array([r["s"] for own in series.values() for r in own])
    found = defaultdict(dict)
    for r in rows("q_mixtures"):
        found[r["kind"]][r["name"]] = r["value"]
    lg = math.lgamma
    density = {
        "student_t": lambda x, a, b: lg(2.5) - lg(2) - 0.5 * math.log(4 * math.pi * b) - 2.5 * np.log(1 + (x - a) ** 2 / (4 * b)),
        "laplace": lambda x, a, b: -np.log(2 * b) - np.abs(x - a) / b,
        "beta": lambda x, a, b: lg(a + b) - lg(a) - lg(b) + (a - 1) * np.log(x) + (b - 1) * np.log(1 - x),
    }

    def update(kind, x, r, a, b):
        if kind == "student_t":
            u = r * 5 / (4 + (x - a) ** 2 / b)
            return (u @ x) / u.sum(), (u @ x**2 - (u @ x) ** 2 / u.sum()) / r.sum()
        if kind == "laplace":
            u = r / np.maximum(np.abs(x - a), 1e-3)
            return (u @ x) / u.sum(), (r @ np.abs(x - a)) / r.sum()
        m = (r @ x) / r.sum()
        k = m * (1 - m) / ((r @ x**2) / r.sum() - m * m) - 1
        return m * k, (1 - m) * k

    for kind, x in (("student_t", np.log1p(s)), ("laplace", np.log1p(s)), ("beta", np.clip((s - s.min()) / np.ptp(s), 1e-4, 1 - 1e-4))):
        r = (x > x.mean()).astype(float)
        ps = [(x.mean(), 1.0), (x.mean(), 1.0)]
        for k in range(13):
            if k:
                r = 1 / (1 + np.exp(-(math.log(w / (1 - w)) + density[kind](x, *ps[1]) - density[kind](x, *ps[0]))))
            w, ps = r.mean(), [update(kind, x, 1 - r, *ps[0]), update(kind, x, r, *ps[1])]
        assert [found[kind][n] for n in ("weight", "a0", "b0", "a1", "b1")] == pytest.approx([w, *ps[0], *ps[1]], rel=1e-3, abs=1e-4), kind


def test_missing_feature_mixture(series, rows):
    def mean(own, kind):
        v = [math.log1p(r["s"]) for r in own if r["event_type"] == kind]
        return np.mean(v) if v else np.nan

    x = np.array([[mean(own, k) for k in ("view", "click")] for own in series.values()])
    mu, var = np.nanmean(x, axis=0), np.nanvar(x, axis=0)
    low, high, w = mu - np.sqrt(var), mu + np.sqrt(var), 0.5
    for _ in range(20):
        p = 1 / (1 + np.exp(-(math.log(w / (1 - w)) + np.nansum(((x - low) ** 2 - (x - high) ** 2) / (2 * var), axis=1))))
        w, seen = p.mean(), ~np.isnan(x)
        one, zero = (p[:, None] * seen).sum(axis=0), ((1 - p)[:, None] * seen).sum(axis=0)
        high, low = np.nansum(p[:, None] * x, axis=0) / one, np.nansum((1 - p)[:, None] * x, axis=0) / zero
        var = (np.nansum(p[:, None] * (x - high) ** 2, axis=0) + np.nansum((1 - p)[:, None] * (x - low) ** 2, axis=0)) / (one + zero)
    found = {r["name"]: r["value"] for r in rows("q_missing_feature_mixture")}
    expected = {"weight": w} | {f"{n}_{c}": v[k] for n, v in (("low", low), ("high", high), ("var", var)) for k, c in enumerate("ab")}
    assert found == pytest.approx(expected, rel=1e-3, abs=1e-4)


def test_kmeans_histogram(series, rows):
    x = np.log1p(np.array([r["s"] for own in series.values() for r in own]))
    lo, hi = x.min(), x.max()
    for _ in range(50):
        up = np.abs(x - hi) < np.abs(x - lo)
        lo, hi = x[~up].mean(), x[up].mean()
    found = {r["name"]: r["value"] for r in rows("q_kmeans_histogram")}
    step = np.ptp(x) / 400  # values count as the middles of their bins
    assert abs(found["low"] - lo) < 3 * step and abs(found["high"] - hi) < 3 * step
    share = [found[f"bin{k}"] for k in range(10)]
    assert share == sorted(share) and share[0] == 0 and share[-1] == 1


def test_kde_valley(series, rows):
    x = np.log1p(np.array([r["s"] for own in series.values() for r in own]))
    found = {r["name"]: r["value"] for r in rows("q_kde_valley")}
    width = 0.9 * min(x.std(), np.subtract(*np.quantile(x, [0.75, 0.25])) / 1.34) * len(x) ** -0.2
    assert found["bandwidth"] == pytest.approx(width, rel=0.02)  # values count as the middles of their bins
    at = np.linspace(x.min() - 3 * width, x.max() + 3 * width, 4001)
    density = np.exp(-0.5 * ((at[:, None] - x) / found["bandwidth"]) ** 2).sum(axis=1)
    modes = [k for k in range(1, 4000) if density[k - 1] < density[k] >= density[k + 1]]
    assert found["modes"] == len(modes)
    if len(modes) < 2:
        assert found["valley"] is None
    else:
        a, b = sorted(sorted(modes, key=lambda k: -density[k])[:2])
        assert found["valley"] == pytest.approx(at[a + density[a : b + 1].argmin()], abs=0.05)


def test_greedy_vector_pairs(spark, sf, rows):
    ids, x, _ = vectors(spark, sf)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = defaultdict(set)
    for r in rows("q_greedy_vector_pairs"):
        found[r["a"] // 64].add((r["a"], r["b"], r["cosine"]))
    for block in set((ids // 64).tolist()):
        at = np.flatnonzero(ids // 64 == block)
        left, right, pairs = set(at[: len(at) // 2].tolist()), set(at[len(at) // 2 :].tolist()), set()
        while left and right:
            c, i, j = max((round(float(x[i] @ x[j]), 9), -i, -j) for i in left for j in right)
            left.remove(-i)
            right.remove(-j)
            pairs.add((int(ids[-i]), int(ids[-j]), round(c, 6)))
        assert found[block] == pairs


def test_confusion_slots(spark, sf, rows):
    said = defaultdict(dict)
    for r in read(spark, sf, "conversations").collect():
        said[r["conv_id"]][r["turn"]] = [w for w in re.split("[ \t\n\r]+", r["text"] or "") if w]
    mass, words = defaultdict(float), defaultdict(dict)
    for r in rows("q_confusion_slots"):
        mass[r["conv_id"], r["kind"], r["slot"]] += r["p"]
        words[r["conv_id"], r["kind"], r["slot"]][r["word"]] = r["p"]
    assert all(p == pytest.approx(1, abs=1e-4) for p in mass.values())
    for conv, turns in said.items():
        first = min((t for t, w in turns.items() if w), default=None)
        if first is None:
            continue
        weight = {t: math.exp((min(turns) - t) / 2) for t in turns}
        own = weight[first] / sum(weight.values())
        for k, w in enumerate(turns[first]):  # the anchor's own words hold at least its share
            assert words[conv, "word", k][w] >= own - 1e-5
        if len(turns) == 1:
            assert {k for c, kind, k in words if c == conv and kind == "insert"} == set()


def test_stream_capacity_tracks(series, rows):
    expected = Counter()
    for gid, own in series.items():
        live = {}

        def end(label, why):
            expected[gid, why, "tracks"] += 1  # noqa: B023
            expected[gid, why, "n"] += live.pop(label)[2]  # noqa: B023

        for r in sorted(own, key=lambda r: (r["t"], r["event_type"])):
            for k in [k for k, v in live.items() if r["t"] - v[1] > 48]:
                end(k, "gap")
            start, _, n = live.get(r["event_type"], (r["t"], 0, 0))
            live[r["event_type"]] = (start, r["t"], n + 1)
            if len(live) > 3:
                end(min(live, key=lambda k: (live[k][0], k)), "capacity")  # noqa: B023
        for k in list(live):
            end(k, "end")
    found = {}
    for r in rows("q_stream_capacity_tracks"):
        found |= {(r["gid"], r["reason"], "tracks"): r["tracks"], (r["gid"], r["reason"], "n"): r["n"]}
    assert found == dict(expected)


def test_exact_tests(series, rows):
    found = {r["gid"]: r for r in rows("q_exact_tests")}
    for gid, own in series.items():
        a, b, c, d = (sum(r["y"] == y and (r["s"] > 50) == up for r in own) for y, up in ((1, True), (1, False), (0, True), (0, False)))
        r, n = found[gid], a + b
        table = lambda x: math.comb(a + b, x) * math.comb(c + d, a + c - x)  # noqa: B023, E731
        assert r["fisher"] == pytest.approx(min(1.0, sum(table(x) for x in range(max(0, a - d), min(n, a + c) + 1) if table(x) <= table(a) * (1 + 1e-7)) / math.comb(a + b + c + d, a + c)), abs=1e-7)
        assert r["sign"] == pytest.approx(sum(math.comb(n, k) for k in range(a, n + 1)) / 2**n, abs=1e-8)
        upper = lambda p: sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(a, n + 1))  # noqa: B023, E731
        lower = lambda p: sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(a + 1))  # noqa: B023, E731
        assert not a and r["low"] == 0 or upper(r["low"]) == pytest.approx(0.025, abs=1e-4)
        assert a == n and r["high"] == 1 or lower(r["high"]) == pytest.approx(0.025, abs=1e-4)


def test_inverse_entropy(rows):
    entropy = lambda p: -(p * math.log(p) + (1 - p) * math.log(1 - p)) if p < 1 else 0.0
    for r in rows("q_inverse_entropy"):
        assert 0.5 <= r["p"] <= 1 and entropy(r["p"]) == pytest.approx(min(r["h"], math.log(2)), abs=1e-5)


def test_word_distance(spark, sf, rows):
    from chronoloom.functions import text as X

    own = defaultdict(dict)
    for r in read(spark, sf, "conversations").select("conv_id", "turn", X.norm_words("text").alias("w")).collect():
        own[r["conv_id"]][r["turn"]] = r["w"]
    found = {(r["conv_id"], r["turn"]): (r["edits"], r["common"]) for r in rows("q_word_distance")}
    for (conv, turn), both in sorted(found.items())[:40]:
        a, b = own[conv][turn], own[conv][min(t for t in own[conv] if t > turn)]
        edits, common = np.arange(len(b) + 1), np.zeros(len(b) + 1, int)
        for w in a:
            e, c = [edits[0] + 1], [0]
            for j, x in enumerate(b):
                e.append(min(edits[j] + (w != x), edits[j + 1] + 1, e[j] + 1))
                c.append(common[j] + 1 if w == x else max(common[j + 1], c[j]))
            edits, common = np.array(e), np.array(c)
        assert both == (edits[-1], common[-1])


@pytest.fixture(scope="module")
def labelled_vectors(spark, sf):
    """Ids, vectors and the label asked for, by id."""
    e = sorted(read(spark, sf, "embeddings").collect(), key=lambda r: r["vec_id"])
    return [r["vec_id"] for r in e], np.array([r["embedding"] for r in e], float), np.array([float(r["label"] == 0) for r in e])


def test_stratified_probe(labelled_vectors, rows):
    ids, x, y = labelled_vectors
    found = {r["vec_id"]: r for r in rows("q_stratified_probe")}
    fold = np.array([found[k]["fold"] for k in ids])
    for own in (0, 1):
        sizes = [((fold == f) & (y == own)).sum() for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    for f in range(5):
        a, b = x[fold != f], x[fold == f]
        mean, sd = a.mean(axis=0), a.std(axis=0)
        z = (a - mean) / sd
        w = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (y[fold != f] - y[fold != f].mean()))
        want = (b - mean) / sd @ w + y[fold != f].mean()
        assert [found[k]["score"] for k, o in zip(ids, fold, strict=True) if o == f] == pytest.approx(want, abs=2e-6)


def test_grouped_folds(series, rows):
    found = {r["event_id"]: r for r in rows("q_grouped_folds")}
    own = [r for one in series.values() for r in one]
    x = np.array([[1.0, r["s"] / 100, r["t"] / 700] for r in own])
    y, fold = np.array([float(r["y"]) for r in own]), np.array([r["gid"] % 5 for r in own])
    for f in set(fold):
        a, b = x[fold != f], np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-a @ b))
            b += np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag([0, 1.0, 1]), a.T @ (y[fold != f] - p) - np.array([0, 1.0, 1]) * b)
        want = 1 / (1 + np.exp(-x[fold == f] @ b))
        mine = [found[r["event_id"]] for r, o in zip(own, fold, strict=True) if o == f]
        assert {r["fold"] for r in mine} == {f} and [r["p"] for r in mine] == pytest.approx(want, abs=2e-6)


def test_standardised_folds(series, rows):
    found = {r["event_id"]: r for r in rows("q_standardised_folds")}
    own = [(r, k) for one in series.values() for k, r in enumerate(one)]
    x = np.array([[r["s"], r["t"], k] for r, k in own], float)
    y, fold = np.array([float(r["y"]) for r, _ in own]), np.array([r["gid"] % 5 for r, _ in own])
    for f in set(fold):
        mean, sd = x[fold != f].mean(axis=0), x[fold != f].std(axis=0)
        z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
        a, b = z[fold != f], np.zeros(4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-a @ b))
            b += np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag([0, 1.0, 1, 1]), a.T @ (y[fold != f] - p) - np.array([0, 1.0, 1, 1]) * b)
        want = 1 / (1 + np.exp(-z[fold == f] @ b))
        mine = [found[r["event_id"]] for (r, _), o in zip(own, fold, strict=True) if o == f]
        assert {r["fold"] for r in mine} == {f} and [r["p"] for r in mine] == pytest.approx(want, abs=2e-6)


def test_leave_one_out(labelled_vectors, rows):
    ids, x, y = labelled_vectors
    found = {r["vec_id"]: r["score"] for r in rows("q_leave_one_out")}
    z = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag(np.r_[1e-9, np.ones(x.shape[1])])
    for k in range(0, len(ids), 7):
        keep = np.arange(len(ids)) != k
        b = np.linalg.solve(z[keep].T @ z[keep] + penalty, z[keep].T @ y[keep])
        assert found[ids[k]] == pytest.approx(z[k] @ b, abs=2e-6)
    assert len(found) == len(ids)


def test_principal_projection(labelled_vectors, rows):
    ids, x, _ = labelled_vectors
    found = {r["vec_id"]: (r["p0"], r["p1"]) for r in rows("q_principal_projection")}
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    axes = np.linalg.svd(z, full_matrices=False)[2][:2]
    for k, axis in enumerate(axes):
        axis = axis * np.sign(axis[np.abs(axis).argmax()])
        assert [found[i][k] for i in ids] == pytest.approx(z @ axis, abs=2e-4)


def test_valley_bootstrap(series, rows):
    from chronoloom.functions.stats import poisson_weights
    from chronoloom.operators.thresholds import kde_valley

    found = rows("q_valley_bootstrap")[0]
    own = [r for one in series.values() for r in one]
    x = np.log1p([r["s"] for r in own])
    weights = poisson_weights(np.array([r["event_id"] for r in own]), 100)
    edges = x.min() + (x.max() - x.min()) / 256 * np.arange(257)
    at = np.minimum(((x - x.min()) / ((x.max() - x.min()) / 256)).astype(int), 255)
    valleys = [kde_valley(np.bincount(at, weights[:, k], 256), (edges[1:] + edges[:-1]) / 2)["valley"] for k in range(100)]
    v = [a for a in valleys if a is not None]
    assert found["without"] == pytest.approx(1 - len(v) / 100)
    if len(v) > 1:
        assert [found[k] for k in ("median", "q1", "q3", "low", "high")] == pytest.approx(np.quantile(v, [0.5, 0.25, 0.75, 0.025, 0.975]), abs=1e-5)
        assert found["sd"] == pytest.approx(np.std(v, ddof=1), abs=1e-5)


def test_high_posterior(series, rows):
    found = {r["event_id"]: r["p"] for r in rows("q_high_posterior")}
    own = [r for one in series.values() for r in one]
    assert set(found) == {r["event_id"] for r in own}
    x, p = np.log1p([r["s"] for r in own]), np.array([found[r["event_id"]] for r in own])
    # the chances give back the components that gave them, but for the last EM step
    w, m = p.mean(), [((1 - p) * x).sum() / (1 - p).sum(), (p * x).sum() / p.sum()]
    v = [((1 - p) * (x - m[0]) ** 2).sum() / (1 - p).sum(), (p * (x - m[1]) ** 2).sum() / p.sum()]
    a, b = (q * np.exp(-((x - c) ** 2) / (2 * s)) / np.sqrt(s) for q, c, s in ((1 - w, m[0], v[0]), (w, m[1], v[1])))
    assert m[0] < m[1] and np.abs(b / (a + b) - p).max() < 0.03


def test_two_level(series, rows):
    found = rows("q_two_level")
    assert {r["gid"] for r in found} == set(series) and len({r["log_likelihood"] for r in found}) == 1
    assert all(0 <= r["w"] <= 1 for r in found) and math.isfinite(found[0]["log_likelihood"])


def test_histogram_thresholds(series, rows):
    """Each method as a plain search over the cuts of a histogram that holds every value."""
    s = np.concatenate([scores(own) for own in series.values()])
    p = (s - s.min()) / np.ptp(s)
    found = {r["method"]: r["threshold"] for r in rows("q_histogram_thresholds")}

    def counted(bins):
        width = 1 / bins
        h = np.bincount(np.minimum(np.floor(p / width), bins - 1).astype(int), minlength=bins).astype(float)
        return h, width * (np.arange(bins) + 0.5)

    def searched(score, bins=256):
        h, x = counted(bins)
        assert h.sum() == len(s)
        best, at = -math.inf, None
        for k in range(1, bins):
            low, high = h[:k], h[k:]
            if low.sum() and high.sum():
                value = score(low, high, x[:k], x[k:])
                if value is not None and value > best + 1e-12:
                    best, at = value, x[k]
        return at

    def side(h, x):
        w = h.sum() / len(s)
        m = (h @ x) / h.sum()
        return w, m, (h @ (x - m) ** 2) / h.sum()

    def between(a, b, x, z):
        (w0, m0, _), (w1, m1, _) = side(a, x), side(b, z)
        return w0 * w1 * (m0 - m1) ** 2

    def least_error(a, b, x, z):
        (w0, _, v0), (w1, _, v1) = side(a, x), side(b, z)
        if v0 <= 1e-15 or v1 <= 1e-15:
            return None
        return -(1 + w0 * math.log(v0) + w1 * math.log(v1) - 2 * (w0 * math.log(w0) + w1 * math.log(w1)))

    def entropies(a, b, x, z):
        return sum(-sum(q * math.log(q) for q in h / h.sum() if q) for h in (a, b))

    def correlation(a, b, x, z):
        return -math.log(((a / len(s)) ** 2).sum() * ((b / len(s)) ** 2).sum()) + 2 * math.log(a.sum() / len(s) * b.sum() / len(s))

    def second_order(a, b, x, z):
        return -sum(math.log(((h / h.sum()) ** 2).sum()) for h in (a, b))

    def cross_entropy(a, b, x, z):
        return sum(w * m * math.log(m) for w, m, _ in (side(a, x), side(b, z)))

    for name, score in (("otsu", between), ("kittler", least_error), ("kapur", entropies), ("yen", correlation), ("renyi", second_order), ("li_lee", cross_entropy)):
        assert found[name] == pytest.approx(searched(score), abs=1e-6), name

    def farthest(bins):
        h, x = counted(bins)
        peak, last = int(h.argmax()), max(k for k in range(bins) if h[k])
        gap = lambda k: abs((h[last] - h[peak]) * (k - peak) - (last - peak) * (h[k] - h[peak]))
        return x[max(range(peak, last + 1), key=lambda k: (gap(k), -k))]

    assert found["triangle"] == pytest.approx(farthest(50), abs=1e-6) and found["rosin"] == pytest.approx(farthest(256), abs=1e-6)
    assert 0 <= found["js_split"] <= 1


def test_gaussian_mixture(series, rows):
    """Plain EM over all rows, from the same start, for as many steps."""
    x = np.log1p(np.concatenate([scores(own) for own in series.values()]))
    found = defaultdict(dict)
    for r in rows("q_gaussian_mixture"):
        found[r["shared"]][r["name"]] = r["value"]
    for shared, own in found.items():
        sd = x.std()
        w, m, v, last = 0.5, [x.mean() - sd, x.mean() + sd], [sd**2, sd**2], -math.inf
        for _ in range(25):
            logs = [math.log(q) - 0.5 * math.log(2 * math.pi * b) - (x - a) ** 2 / (2 * b) for q, a, b in zip((1 - w, w), m, v, strict=True)]
            total = np.logaddexp(*logs)
            r = np.exp(logs[1] - total)
            w, m = r.mean(), [((1 - r) @ x) / (1 - r).sum(), (r @ x) / r.sum()]
            v = [((1 - r) @ (x - m[0]) ** 2) / (1 - r).sum(), (r @ (x - m[1]) ** 2) / r.sum()]
            if shared:
                v = [(1 - w) * v[0] + w * v[1]] * 2
            if abs(total.sum() - last) < 1e-7 * abs(last):
                break
            last = total.sum()
        expected = {"weight": w, "mean0": m[0], "mean1": m[1], "var0": v[0], "var1": v[1]}
        assert {k: own[k] for k in expected} == pytest.approx(expected, abs=2e-4), shared
        density = lambda t, q, a, b: q * math.exp(-((t - a) ** 2) / (2 * b)) / math.sqrt(2 * math.pi * b)
        sides = [density(own["crossing"], q, a, b) for q, a, b in zip((1 - w, w), m, v, strict=True)]
        assert min(m) <= own["crossing"] <= max(m) and (sides[0] == pytest.approx(sides[1], rel=0.02) or own["crossing"] == pytest.approx(min(m), abs=0.01) or own["crossing"] == pytest.approx(max(m), abs=0.01))
        assert 0 < own["error"] <= min(w, 1 - w) + 1e-3


def test_stream_track_records(series, rows):
    """Plain tracks of all rows in order."""
    expected = []
    for gid, own in series.items():
        live, following = {}, 0

        def end(label, reason):
            track, start, last, n = live.pop(label)
            expected.append((gid, track, label, "end", round(last, 6), round(start, 6), n, reason))

        for r in sorted(own, key=lambda r: (r["t"], r["event_type"])):
            for label in [k for k, v in live.items() if r["t"] - v[2] > 48]:
                end(label, "gap")
            if r["event_type"] not in live:
                live[r["event_type"]] = [following, r["t"], r["t"], 0]
                following += 1
            v = live[r["event_type"]]
            v[2:] = [r["t"], v[3] + 1]
            expected.append((gid, v[0], r["event_type"], "support", round(r["t"], 6), round(v[1], 6), v[3], None))
            if len(live) > 3:
                end(min(live, key=lambda k: live[k][1]), "capacity")
        for label in list(live):
            end(label, "gap")
    found = [tuple(r.values()) for r in rows("q_stream_track_records")]
    assert sorted(map(str, found)) == sorted(map(str, expected))
    assert {r[-1] for r in found} == {None, "gap", "capacity"}


def test_tracks_do_not_depend_on_batches(spark, tmp_path):
    """A key with most rows, in one batch or in many runs that go on from the checkpoint, in and out of order."""
    import datetime

    from chronoloom.streaming import stateful, trackers
    from chronoloom.streaming.stores import rocks

    rng = np.random.default_rng(8)
    zero = datetime.datetime(2024, 1, 1)
    rows_ = [(int(g), str(rng.choice(list("abcd"))), float(t)) for g, t in zip(rng.choice([1, 1, 1, 2], 3_000), np.sort(rng.uniform(0, 900, 3_000)), strict=True)]
    rows_ += [(g, None, 2_000.0) for g in (1, 2)]
    schema = "gid bigint, label string, t double, ts timestamp"
    full = [(*r, zero + datetime.timedelta(hours=r[2])) for r in rows_]
    got = []
    with rocks(spark):
        for name, parts in (("once", [full]), ("many", [full[k : k + 750] for k in range(0, 3_001, 750)])):
            for part in parts:
                mixed = [part[i] for i in rng.permutation(len(part))]
                spark.createDataFrame(mixed, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/{name}")
                stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
                found = stateful.drained(trackers.records(stream, 30.0, 2, 12.0, "1 hour", 1_704_067_200_000), name, str(tmp_path))
            got.append(sorted(map(str, map(tuple, found.collect()))))
    assert got[0] == got[1] and len([r for r in got[0] if "'support'" in r]) == 3_000


def test_tracks_of_a_key_cost_few_calls_of_the_state_store(monkeypatch):
    """Rows of 300 slots in one timer; with rows in the map, the same records."""
    import pandas as pd

    from chronoloom.streaming import trackers

    class Handle:
        def __init__(self):
            self.calls, self.value, self.map, self.timers = 0, None, {}, set()

        def counted(self, result=None):
            self.calls += 1
            return result

        def getValueState(self, *_):
            own = type("Value", (), {})()
            own.exists, own.get, own.update = lambda: self.counted(self.value is not None), lambda: self.counted(self.value), lambda v: self.counted(setattr(self, "value", v))
            return own

        def getMapState(self, *_):
            own = type("Map", (), {})()
            own.containsKey, own.getValue = lambda k: self.counted(k in self.map), lambda k: self.counted(self.map[k])
            own.updateValue, own.removeKey, own.iterator = lambda k, v: self.counted(self.map.update({k: v})), lambda k: self.counted(self.map.pop(k)), lambda: self.counted(iter(list(self.map.items())))
            return own

        def registerTimer(self, at):
            self.counted(self.timers.add(at))

        def deleteTimer(self, at):
            self.counted(self.timers.discard(at))

    class At:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    rng = np.random.default_rng(3)
    rows_ = pd.DataFrame({"label": rng.choice(list("abcd"), 900), "t": rng.permutation(np.linspace(0, 3_599, 900))})
    found = []
    for held in (4_096, 50):
        monkeypatch.setattr(trackers, "HELD", held, raising=False)
        handle, out = Handle(), []
        tracker = trackers.Tracker(30.0, 3, 12.0, 0)
        tracker.init(handle)
        list(tracker.handleInputRows((1,), iter([rows_[:400], rows_[400:]]), At(0)))
        for watermark in (2_000 * trackers.HOUR_MS, 4_000 * trackers.HOUR_MS):
            while due := sorted(t for t in handle.timers if t <= watermark):
                expired = type("Expired", (), {"getExpiryTimeInMs": lambda self, at=due[0]: at})()
                out += [tuple(r) for f in tracker.handleExpiredTimer((1,), At(watermark), expired) for r in f.itertuples(index=False)]
                handle.timers.discard(due[0])
        assert not handle.timers and not handle.map and sum(r[3] == "support" for r in out) == 900
        assert held == 50 or handle.calls < 20
        found.append(sorted(map(str, out)))
    assert found[0] == found[1]


def test_sparse_node_scores(spark, sf, rows):
    """The dense solution of the same fit."""
    from chronoloom.plans.graphs import _day_edges

    edges = [tuple(r) for r in _day_edges(spark, sf).collect() if r["a"] != r["b"]]
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    at = {n: k for k, n in enumerate(nodes)}
    m = np.zeros((len(edges) + 1, len(nodes)))
    for k, (a, b, _) in enumerate(edges):
        m[k, at[a]], m[k, at[b]] = 1, -1
    m[-1] = 1
    expected = np.linalg.lstsq(m, np.array([*(v for *_, v in edges), 0.0]), rcond=None)[0]
    found = {r["node"]: r["score"] for r in rows("q_sparse_node_scores")}
    assert [found[n] for n in nodes] == pytest.approx(expected, abs=2e-5) and len(found) == len(nodes)


def test_node_scores_of_components(spark):
    from chronoloom.operators.graphs import node_scores

    edges = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 2.0), (7, 8, -4.0), (7, 8, -4.0), (9, 9, 5.0), (8, 7, None)]
    found = {r["node"]: r["score"] for r in node_scores(spark.createDataFrame(edges, "a bigint, b bigint, v double")).collect()}
    assert found == {1: pytest.approx(1), 2: pytest.approx(0, abs=1e-9), 3: pytest.approx(-1), 7: pytest.approx(-2), 8: pytest.approx(2)}


def plain_greedy(left, right):
    unit = lambda v: np.array(v, dtype=float) / max(np.linalg.norm(v), 1e-300)
    cos = {(a, b): round(float(unit(x) @ unit(y)), 9) for a, x in left for b, y in right}
    out, used = set(), (set(), set())
    for a, b in sorted(cos, key=lambda p: (-cos[p], p)):
        if a not in used[0] and b not in used[1]:
            used[0].add(a)
            used[1].add(b)
            out.add((a, b))
    return out


def test_greedy_two_sides(spark, sf, rows):
    e = [(r["vec_id"], r["embedding"], r["label"]) for r in read(spark, sf, "embeddings").collect()]
    expected = plain_greedy([(i, v) for i, v, k in e if k < 5], [(i, v) for i, v, k in e if k >= 5])
    assert {(r["a"], r["b"]) for r in rows("q_greedy_two_sides")} == expected


def test_greedy_pairs_of_ties_and_zeros(spark):
    from chronoloom.operators.pairing import greedy_pairs

    rng = np.random.default_rng(2)
    some = lambda n: [(i, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(n)]
    left, right = some(30), some(45)
    frames = [spark.createDataFrame(x, "vec_id bigint, embedding array<double>") for x in (left, right)]
    assert {(r["a"], r["b"]) for r in greedy_pairs(*frames, k=3, block_rows=20).collect()} == plain_greedy(left, right)
    assert greedy_pairs(frames[0], frames[1].where("false")).count() == 0


def written_events(spark, path, rows_):
    """(user, minute, value) as an events table."""
    import datetime

    zero = datetime.datetime(2024, 1, 1)
    full = [(k, zero + datetime.timedelta(minutes=t), u, "view", float(v), "{}") for k, (u, t, v) in enumerate(rows_)]
    spark.createDataFrame(full, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.mode("overwrite").parquet(f"{path}/events")
    (part,) = [p for p in (path / "events").iterdir() if p.suffix == ".parquet"]
    part.rename(path / "events.parquet")


def same_as_sql(spark, path, name):
    """Exactly the SQL's rows."""
    from test_oracles import QUERIES, ordered, run_sql

    df = QUERIES[name](spark, str(path))
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == ordered(*run_sql(name, str(path)))


def test_probability_scalars_of_a_full_chance(spark, tmp_path):
    written_events(spark, tmp_path, [(1, k, v) for k, v in enumerate((0, 50, 602.5, 784.6, 785, 900, 2_000))])
    same_as_sql(spark, tmp_path, "q_probability_scalars")


def test_max_sum_stretch_of_equal_sums(spark, tmp_path):
    """Sums that are equal but for the last bits of a running sum, and stretches of no gain before and after the best."""
    rng = np.random.default_rng(7)
    values = [(u, rng.choice([49.7, 49.8, 49.9, 50.0, 50.1, 50.2, 50.3], n)) for u, n in enumerate([1, 2, 3, 5, 9, 30, 60] * 12)]
    written_events(spark, tmp_path, [(u, k, v) for u, own in values for k, v in enumerate(own)])
    same_as_sql(spark, tmp_path, "q_max_sum_stretch")


def test_forward_backward_to_the_last_digit(spark, tmp_path):
    """Readings of sf0.1 where nine digits depend on the last bits, alone and in one long series."""
    e = spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("user_id in (181, 975)").orderBy("ts", "event_id").collect()
    own = [(r["user_id"], k, r["value"]) for k, r in enumerate(e)]
    written_events(spark, tmp_path, own + [(1, k, v) for k, (_, _, v) in enumerate(own * 5)])
    same_as_sql(spark, tmp_path, "q_forward_backward")


def test_forward_backward_of_values_without_likelihood(spark, tmp_path):
    """Values so far out that both likelihoods are 0, or so nearly that the state before decides, NaN and null: the whole series has no chances, over any number of blocks."""
    import duckdb

    none, rng = -1.0, np.random.default_rng(3)
    own = []
    for odd in ([820.0], [836.0], [837.0], [1e300], [math.inf], [math.nan], [none], [900.0, none], [math.nan, none]):
        for n, at in ((2, 0), (65, 10), (65, 63), (200, 150), (400, 70)):
            v = np.round(rng.exponential(50, n), 2).tolist()
            v[at : at + len(odd)] = odd
            own.append(v)
    written_events(spark, tmp_path / "given", [(u, k, x) for u, v in enumerate(own) for k, x in enumerate(v)])
    duckdb.sql(f"SELECT * REPLACE (CASE WHEN value = {none} THEN NULL ELSE value END AS value) FROM '{tmp_path}/given/events.parquet'").write_parquet(f"{tmp_path}/events.parquet")
    same_as_sql(spark, tmp_path, "q_forward_backward")


def test_two_states_are_a_loop(spark):
    import math

    from chronoloom.operators import scans

    steps, start = ((0.9, 0.1), (0.2, 0.8)), (2.0, 1.0)
    logs = lambda x: (-0.5 * (x + 0.7) ** 2, -0.5 * (x - 0.7) ** 2)
    rng = np.random.default_rng(4)
    series_ = {n: rng.normal(size=n).tolist() for n in (1, 63, 64, 65, 700)}
    table = spark.createDataFrame([(g, i, len(v), x) for g, v in series_.items() for i, x in enumerate(v)], "gid bigint, idx bigint, n bigint, s double")
    found = defaultdict(list)
    for r in scans.two_states(table, "s", scans.TwoStates(start, steps, logs)).orderBy("gid", "idx").collect():
        found[r["gid"]].append(r["p"])
    for g, v in series_.items():
        filtered, ahead, p = [], [], None
        for x in v:
            a, b = start if p is None else (0.9 * p + 0.2 * (1 - p), 0.1 * p + 0.8 * (1 - p))
            c, d = map(math.exp, logs(x))
            p = a * c / (a * c + b * d)
            filtered.append(p)
            ahead.append((a, b))
        smooth = [p]
        for p, (a, b) in zip(filtered[-2::-1], ahead[:0:-1], strict=True):
            smooth.append(p * (0.9 * smooth[-1] / a + 0.1 * (1 - smooth[-1]) / b))
        assert found[g] == smooth[::-1], g


def test_search_of_large_batches_in_little_memory(spark):
    """Two thousand queries against Arrow batches of 10,000 rows, with ties: products of a task stay small, and the result is that of all pairs."""
    import tracemalloc

    import pandas as pd
    import pyarrow as pa

    from chronoloom.operators import graphs

    class Caught(Exception):
        pass

    class Items:
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            raise Caught(f)

    rng = np.random.default_rng(6)
    v = rng.integers(-3, 4, (20_000, 4)).astype(np.float32)
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 20_000, 10)], "vec_id bigint, embedding array<float>")
    for side in ("both", "after"):
        with pytest.raises(Caught) as caught:
            graphs.cosine_topk(queries, Items(), 3, side=side)
        batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + 10_000)), pa.array(v[a : a + 10_000].tolist(), pa.list_(pa.float32()))], ["vec_id", "embedding"]) for a in (0, 10_000)]
        tracemalloc.start()
        found = pd.concat(b.to_pandas() for b in caught.value.args[0](iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 150 << 20
        unit = v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-300)
        held = {q: list(own["vec_id"]) for q, own in found.sort_values(["qid", "cosine", "vec_id"], ascending=[True, False, True]).groupby("qid")}
        for q in (0, 10, 9_990, 15_000):
            cos = np.round(unit @ unit[q], 9)
            own = [i for i in np.lexsort((np.arange(20_000), -cos)) if (i > q if side == "after" else i != q)][:3]
            assert held[q] == own


def test_long_tables_are_numbered_only_where_positions_are_read(spark, sf, monkeypatch):
    from chronoloom.plans import frames

    asked = []
    ranked = frames.ranked_curve
    monkeypatch.setattr(frames, "TOGETHER", 0)
    monkeypatch.setattr(frames, "_sizes", {})
    monkeypatch.setattr(frames, "ranked_curve", lambda *a: asked.append(a) or ranked(*a))
    q = entry_module.queries()
    for name in ("q_logistic_fit", "q_grouped_folds", "q_matched_budget", "q_trimmed_stats", "q_group_metrics"):
        q[name](spark, sf)
        assert not asked, name
    once = q["q_standardised_folds"](spark, sf)
    assert len(asked) == 1 and "Window" not in once._jdf.queryExecution().toString()

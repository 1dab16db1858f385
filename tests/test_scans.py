"""Block scans against the recurrences of one series, and token groups against plain loops."""

import math
from collections import defaultdict

import numpy as np
import pytest

from chronoloom.operators import scans as N
from chronoloom.operators import sequence as Q
from chronoloom.operators import tokens as K

STEP, START = np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([2 / 3, 1 / 3])
LENGTHS = (1, 2, 63, 64, 65, 128, 700, 4_097, 5_000)


def _emitted():
    return lambda x: np.column_stack([-0.5 * (x[:, 0] + 0.7) ** 2, -0.5 * (x[:, 0] - 0.7) ** 2])


emitted = _emitted()  # sent to workers by value, as they don't import tests


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(4)
    values = {g: np.round(rng.normal(0, 1.5, n), 3) for g, n in enumerate(LENGTHS)}
    rows = [(g, i, len(v), float(x)) for g, v in values.items() for i, x in enumerate(v)]
    return values, spark.createDataFrame(rows, "gid bigint, idx bigint, n bigint, s double").repartition(7)


def gathered(df, value):
    out = defaultdict(dict)
    for r in df.collect():
        out[r["gid"]][r["idx"]] = r[value]
    return {g: np.array([v[i] for i in range(len(v))]) for g, v in out.items()}


def test_posteriors_of_long_series(many):
    values, df = many
    found = gathered(N.posteriors(df, ["s"], N.constant(emitted, STEP, START)), "p")
    for g, v in values.items():
        assert found[g] == pytest.approx(Q.forward_backward(emitted(v[:, None]), STEP, START), abs=1e-10)


def test_averaged_chains_of_long_series(many):
    values, df = many

    def chains(n):
        stay = 1 - 1 / np.linspace(2, max(n, 3), 3)
        return np.array([[[a, 1 - a], [1 - a, a]] for a in stay]), np.full((3, 2), 0.5)

    found = gathered(N.posteriors(df, ["s"], N.Chains(emitted, chains)), "p")
    for g, v in values.items():
        assert found[g] == pytest.approx(Q.averaged_posterior(emitted(v[:, None]), *chains(len(v)))[1], abs=1e-9)


def test_best_paths_of_long_series(many):
    values, df = many
    found = gathered(N.best_paths(df, ["s"], N.constant(emitted, STEP, START)), "state")
    for g, v in values.items():
        assert (found[g] == Q.viterbi(emitted(v[:, None]), STEP, START)).all(), len(v)


def test_best_paths_with_impossible_steps_and_ties(spark):
    level = lambda x: np.column_stack([-((x[:, 0] - k) ** 2) for k in range(3)])
    values = {0: np.repeat([0.0, 1.0, 2.0], 90), 1: np.repeat([2.0, 0.0], 100), 2: np.full(200, 0.5), 3: np.array([1.0])}
    df = spark.createDataFrame([(g, i, len(v), float(x)) for g, v in values.items() for i, x in enumerate(v)], "gid bigint, idx bigint, n bigint, s double")
    found = gathered(N.best_paths(df, ["s"], N.constant(level, Q.onward(3), np.ones(3) / 3)), "state")
    for g, v in values.items():
        assert (found[g] == Q.legal_phases(level(v[:, None]))).all(), g
    chance = gathered(N.posteriors(df, ["s"], N.constant(level, Q.onward(3), np.ones(3) / 3)), "p")
    for g, v in values.items():
        assert chance[g] == pytest.approx(Q.forward_backward(level(v[:, None]), Q.onward(3), np.ones(3) / 3), abs=1e-10)


def test_empty_series(spark):
    df = spark.createDataFrame([], "gid bigint, idx bigint, n bigint, s double")
    assert N.posteriors(df, ["s"], N.constant(emitted, STEP, START)).count() == N.best_paths(df, ["s"], N.constant(emitted, STEP, START)).count() == 0


def plain_groups(x, salience, static, how):
    """Groups of a frame by loops: {root: (kind, {member: weight})}."""
    n, still, moved = len(x), [i for i in range(len(x)) if static[i]], [i for i in range(len(x)) if not static[i]]
    total = min(how.budget, n)
    ks = total * len(still) // n
    d = {(i, j): math.dist(x[i], x[j]) / math.sqrt(len(x[0])) for i in still for j in still}
    centres = still
    if 0 < ks < len(still):
        density = {}
        for i in still:
            near = sorted(d[i, j] for j in still)[: min(how.neighbours, len(still) - 1)]
            density[i] = math.exp(-sum(v * v for v in near) / len(near))
        score = {i: density[i] * min(d[i, j] if density[i] > density[j] or (density[i] == density[j] and i < j) else max(d.values()) for j in still) for i in still}
        centres = sorted(sorted(still, key=lambda i: (-score[i], i))[:ks])
    out = {c: ("static", [c]) for c in centres} if ks else {}
    for i in still if ks else []:
        if i not in centres:
            out[min(centres, key=lambda c: (d[i, c], c))][1].append(i)
    weighed = {c: (kind, {m: 1.0 if len(own) == 1 else how.centre_weight if m == c else (1 - how.centre_weight) / (len(own) - 1) for m in own}) for c, (kind, own) in out.items()}
    return weighed | {i: ("dynamic", {i: 1.0}) for i in sorted(moved, key=lambda i: (-salience[i], i))[: total - ks]}


@pytest.mark.parametrize("budget", [1, 5, 12, 50])
def test_groups_of_a_frame(budget):
    rng = np.random.default_rng(budget)
    how = K.Grouping(budget=budget, neighbours=4)
    for share in (0, 0.3, 0.7, 1):
        for n in (1, 2, 13, 30):
            x, salience, static = rng.normal(0, 1, (n, 6)), rng.integers(0, 4, n).astype(float), rng.random(n) < share
            found = defaultdict(lambda: [None, {}])
            for root, kind, member, weight in K.frame_groups(np.arange(n), x, salience, static, how):
                found[root][0] = kind
                found[root][1][member] = weight
            expected = plain_groups(x, salience, static, how)
            assert {r: (k, m) for r, (k, m) in found.items()} == {r: (k, pytest.approx(m)) for r, (k, m) in expected.items()}
            assert len(found) == min(budget, n)


def test_equal_points_stay_groups():
    """Centres at one point are members of themselves."""
    rows = K.frame_groups(np.arange(6), np.ones((6, 3)), np.zeros(6), np.ones(6, bool), K.Grouping(budget=3))
    assert {r for r, *_ in rows} == {0, 1, 2} and len(rows) == 6 and all(abs(sum(w for r, _, _, w in rows if r == c) - 1) < 1e-12 for c in range(3))


def test_frames_that_start_anew(spark):
    v = [1.0, 0.0]
    rows = [(1, f, t, n, v, 0.0) for f, n in ((0, 2), (1, 2), (3, 2), (4, 3)) for t in range(n)]
    df = spark.createDataFrame(rows, "gid bigint, frame bigint, token bigint, n int, v array<double>, salience double")
    static = {(r["frame"], r["token"]) for r in K.compared(df).where("static").collect()}
    assert static == {(1, 0), (1, 1)}  # frame 2 is missing, and frame 4 has another number of tokens

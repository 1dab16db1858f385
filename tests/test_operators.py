"""Interval, as-of, rank and metric operators on hand cases and random brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import scalars as S
from chronoloom.functions import stats, text
from chronoloom.operators import asof as A
from chronoloom.operators import graphs as G
from chronoloom.operators import intervals as I
from chronoloom.operators import metrics as M
from chronoloom.operators import quantiles
from chronoloom.operators import ranks as R
from chronoloom.operators import thresholds as T
from chronoloom.operators.quantiles import percentiles


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


SPANS = "gid bigint, ord int, start double, end double, v double"


def random_spans(seed, n=60):
    rng = random.Random(seed)
    return [(rng.randrange(3), k, float(a := rng.randrange(0, 100)), float(a + rng.choice([0, 1, 5, 30])), float(rng.randrange(9))) for k in range(n)]


def test_range_join_by_brute_force(spark):
    spans, points = random_spans(1), [(g, float(t)) for g in range(4) for t in range(-3, 140, 2)]
    expected = sorted((g, t, k) for g, t in points for h, k, a, b, _ in spans if g == h and a <= t < b)
    p, s = frame(spark, points, "gid bigint, t double"), frame(spark, spans, SPANS)
    for width in (1.0, 7.0, 1000.0):
        assert sorted(tuple(r) for r in I.points_in_spans(p, s, width).select("gid", "t", "ord").collect()) == expected
    inside = {(g, t) for g, t, _ in expected}
    assert {tuple(r) for r in I.points_in_spans(p, s, 7.0, how="left_semi").collect()} == inside
    assert {tuple(r)[:2] for r in I.points_in_spans(p, s, 7.0, how="left").where("ord is null").collect()} == set(points) - inside


def test_overlaps_by_brute_force(spark):
    spans, windows = random_spans(2), [(g, float(a), float(a + 13)) for g in range(3) for a in range(0, 130, 11)]
    expected = sorted((g, a, k, min(b, d) - max(a, c)) for g, a, b in windows for h, k, c, d, _ in spans if g == h and min(b, d) > max(a, c))
    w, s = frame(spark, windows, "gid bigint, a double, b double"), frame(spark, spans, SPANS)
    for width in (3.0, 500.0):
        assert sorted(tuple(r) for r in I.overlaps(w, s, width).select("gid", "a", "ord", "overlap").collect()) == expected


def test_asof_and_nearest_by_brute_force(spark):
    rng = random.Random(3)
    samples = [(g, t, float(rng.randrange(100))) for g in (1, 2) for t in sorted(rng.sample([x / 2 for x in range(0, 200)], 25))]
    points = [(g, float(t)) for g in (1, 2, 3) for t in range(-5, 110)]
    p, s = frame(spark, points, "gid bigint, t double"), frame(spark, samples, "gid bigint, t double, v double")
    own = lambda g: [(t, v) for h, t, v in samples if h == g]
    for width in (4.0, 1000.0):
        back = {(r["gid"], r["t"]): r["found"] and tuple(r["found"]) for r in A.asof(p, s, width).collect()}
        ahead = {(r["gid"], r["t"]): r["found"] and tuple(r["found"]) for r in A.asof(p, s, width, ahead=True).collect()}
        near = {(r["gid"], r["t"]): r["found"] and tuple(r["found"]) for r in A.nearest(p, s, width).collect()}
        for g, t in points:
            assert back[g, t] == max((x for x in own(g) if x[0] <= t), default=None)
            assert ahead[g, t] == min((x for x in own(g) if x[0] >= t), default=None)
            assert near[g, t] == min(own(g), key=lambda x: (abs(x[0] - t), x[0]), default=None)


def test_merge_touching_and_strict(spark):
    s = frame(spark, [(1, 0, 0.0, 2.0, 1.0), (1, 1, 2.0, 3.0, 5.0), (1, 2, 4.0, 4.0, 9.0), (1, 3, 3.5, 6.0, 2.0)], SPANS)
    rows = lambda df: sorted((r["start"], r["end"], r["n"], r["v"]) for r in df.collect())
    assert rows(I.merged(s)) == [(0.0, 3.0, 2, 5.0), (3.5, 6.0, 1, 2.0)]
    assert rows(I.merged(s, strict=True)) == [(0.0, 2.0, 1, 1.0), (2.0, 3.0, 1, 5.0), (3.5, 6.0, 1, 2.0)]
    assert rows(I.merged(s, gap=0.5)) == [(0.0, 6.0, 3, 5.0)]


AUC = [([3.0, 2.0, 1.0, 0.0], [1, 1, 0, 0], 1.0), ([0.0, 1.0, 2.0, 3.0], [1, 1, 0, 0], 0.0), ([1.0, 1.0, 1.0, 1.0], [1, 0, 1, 0], 0.5), ([1.0, 2.0], [1, 1], None)]


@pytest.mark.parametrize(("s", "y", "auc"), AUC)
def test_auc_hand_cases(spark, s, y, auc):
    df = frame(spark, list(zip(s, y, strict=True)), "s double, y int")
    assert M.rank_metrics(df, "s", "y").first()["auc"] == auc


def test_rank_metrics_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(k % 5, rng.choice([0.0, 1.0, 1.5, 2.0, math.nan, None, 7.0]), rng.randrange(2) if k % 5 else 1) for k in range(300)]
    df = frame(spark, rows, "g int, s double, y int")

    def expected(own):
        own = [(s, y) for s, y in own if s is not None and not math.isnan(s)]
        pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
        if not pos or not neg:
            return None, None
        auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
        ap = sum(sum(p == s for p in pos) * sum(p >= s for p in pos) / sum(x >= s for x, _ in own) for s in set(pos)) / len(pos)
        return auc, ap

    got = M.rank_metrics(df, "s", "y").first()
    assert (got["auc"], got["ap"]) == pytest.approx(expected([r[1:] for r in rows]))
    for r in M.rank_metrics(df, "s", "y", ["g"]).collect():
        e = expected([x[1:] for x in rows if x[0] == r["g"]])
        assert (r["auc"], r["ap"]) == (e if e[0] is None else pytest.approx(e))


def test_global_rank_equals_a_sort(spark):
    rng = random.Random(5)
    rows = [(float(rng.randrange(20)), k) for k in range(500)]
    ranked = R.global_rank(frame(spark, rows, "s double, k int"), ["s", "k"])
    assert [r["k"] for r in ranked.orderBy("rank").collect()] == [k for _, k in sorted(rows)]
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(500))


def test_windows_and_grids(spark):
    d = F.lit(30.4)
    assert one(spark, S.n_frames(F.lit(30.0), 1.0), S.n_frames(d, 1.0), S.n_frames(F.lit(0.0), 1.0)) == (30, 31, 1)
    assert [tuple(w) for w in one(spark, S.fixed_windows(F.lit(5.0), 2.0))[0]] == [(0.0, 2.0), (2.0, 4.0), (4.0, 5.0)]
    assert one(spark, S.sparse_indices(F.lit(1), 16), S.sparse_indices(F.lit(4), 16), S.sparse_indices(F.lit(0), 16)) == ([0], [0, 1, 2, 3], [])
    import numpy as np

    assert one(spark, S.sparse_indices(F.lit(227), 16))[0] == sorted(set(np.rint(np.linspace(0, 226, 16)).astype(int).tolist()))


def test_fixed_length_and_pooling(spark):
    xs = F.array(*[F.lit(float(x)) for x in range(6)])
    assert one(spark, S.fixed_length(xs, 3), S.fixed_length(xs, 8)) == ([0.5, 2.5, 4.5], [0.0, 1, 2, 3, 4, 5, 0, 0])
    ps = F.array(F.lit(0.5), F.lit(None).cast("double"), F.lit(1.0))
    assert one(spark, S.noisy_or(ps), S.top_mean(ps, 2), S.log_sum_exp(F.array(F.lit(None).cast("double")))) == (1.0, 0.75, None)


def test_inverse_entropy(spark):
    p = one(spark, S.inverse_entropy(S.entropy(F.lit(0.2))))[0]
    assert p == pytest.approx(0.8)


def test_exact_intervals_and_tests(spark):
    low, high = one(spark, stats.clopper_pearson(F.lit(3), F.lit(10)))[0]
    assert (low, high) == pytest.approx((0.066740, 0.652453), abs=1e-5)
    assert one(spark, stats.fisher(F.lit(3), F.lit(1), F.lit(1), F.lit(3)))[0] == pytest.approx(0.485714, abs=1e-6)
    assert one(spark, stats.sign_test(F.lit(4), F.lit(1)))[0] == pytest.approx(6 / 32)


def test_thresholds_split_two_heaps(spark):
    rows = [(float(x),) for x in [*range(0, 20)] * 5 + [*range(80, 100)] * 5]
    h, x = T.histogram(frame(spark, rows, "s double"), "s", 50)
    assert h.sum() == 200
    found = T.histogram_thresholds(frame(spark, [(r[0] / 100,) for r in rows], "s double"), "s")
    for name in ("otsu", "kittler", "kapur", "yen", "renyi"):
        assert 0.15 < found[name] < 0.85, name
    assert 19 < T.gap_split(frame(spark, rows, "s double"), "s").first()[0] < 80
    assert 20 < T.kde_valley(h, x)["valley"] < 80
    g = T.gaussian_mixture(frame(spark, rows, "s double"), "s")
    assert g["mean0"] == pytest.approx(9.5, abs=0.5) and g["mean1"] == pytest.approx(89.5, abs=0.5) and g["weight"] == pytest.approx(0.5, abs=0.01)
    assert 30 < T.crossing(g)[0] < 70


def test_components_and_hops(spark):
    e = frame(spark, [(1, 2), (2, 3), (5, 4), (7, 7)], "a bigint, b bigint")
    assert {tuple(r) for r in G.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    chain = frame(spark, [(k, k + 1) for k in range(40)], "a bigint, b bigint")
    assert {r["root"] for r in G.components(chain).collect()} == {0}
    hops = G.within_hops(chain, frame(spark, [(0,)], "node bigint"), 2)
    assert {tuple(r) for r in hops.collect()} == {(0, 0), (1, 1), (2, 2)}


def test_topk_in_blocks(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where("vec_id % 7 = 0")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(G.cosine_topk(q, e, 3)) == rows(G.cosine_topk(q, e, 3, block_rows=2))


def test_nearest_of_all_equals_topk(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    e = e.unionByName(e.where("vec_id % 3 = 0").withColumn("vec_id", F.col("vec_id") + 10_000))  # equal vectors, so ties
    e = e.unionByName(e.where("vec_id = 0").select(F.lit(20_000).cast("long").alias("vec_id"), F.transform("embedding", lambda x: x * 0).alias("embedding"), "label"))
    e = e.unionByName(e.where("vec_id = 1").select(F.explode(F.sequence(F.lit(30_000).cast("long"), F.lit(30_060).cast("long"))).alias("vec_id"), "embedding", "label"))
    rows = lambda df: sorted((*map(int, r[:2]), round(r[2], 8)) for r in df.collect())
    expected = rows(G.cosine_topk(e, e, 4))
    assert len(expected) == 4 * e.count()
    for block_rows in (5000, 150, 9):
        assert rows(G.nearest_of_all(e, 4, block_rows)) == expected


@pytest.mark.parametrize("name", ["q_label_spread", "q_harmonic_labels", "q_majority_propagation", "q_density_peaks"])
def test_neighbour_graphs_have_all_items(spark, sf, tmp_path, name):
    from chronoloom.plans import catalog

    e = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 60")
    e.withColumn("vec_id", F.col("vec_id") + 1970).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(r["node"] for r in catalog.queries()[name](spark, str(tmp_path)).select("node").collect()) == list(range(1970, 2030))


def test_text_functions(spark):
    t = lambda s: F.lit(s)
    assert one(spark, *[text.parse_clock(t(x)) for x in ("1:02:03.9", "02:03", "7", "x", "1:2:3:4")]) == (3723, 123, 7, None, None)
    assert [tuple(s) for s in one(spark, text.parse_spans(t("[[3, 1.5], [4,5], [x,1]]")))[0]] == [(1.5, 3.0), (4.0, 5.0)]
    assert one(spark, text.collapse_repeats(t("a b a b a b c c d")))[0] == "a b c d"
    assert tuple(one(spark, text.word_distance(F.split(t("a b c d"), " "), F.split(t("a c d e"), " ")))[0]) == (2, 3)
    assert one(spark, text.clause_key(t("Ｆoo,  ß!")))[0] == "foo ss"
    assert one(spark, text.clean_json(t(" ```json\n{\"a\": 1}\n``` ")), text.clean_json(t("{oops")))[0] == '{"a": 1}'
    assert one(spark, text.label_prefix(t('{"why": "x", "label": 3}')))[0] == '{"why": "x", "label": '


def test_collapse_repeats_of_some_texts_at_a_time(spark, monkeypatch):
    """Texts come back in their order, whatever the number taken at a time; nulls are empty; and few are strings at once."""
    r = random.Random(3)
    texts = [None, "", " a  a ", "a b c d a b c d", *(" ".join(r.choice("ab") for _ in range(r.randrange(40))) for _ in range(400))]

    def plain(t):
        own, changed = (t or "").split(), True
        while changed:
            changed = False
            for n in (4, 3, 2, 1):
                out = []
                for w in own:
                    out.append(w)
                    if len(out) >= 2 * n and out[-n:] == out[-2 * n : -n]:
                        del out[-n:]
                        changed = True
                own = out
        return " ".join(own)

    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    for some in (7, text.SOME_TEXTS, 1000):
        monkeypatch.setattr(text, "SOME_TEXTS", some)
        assert {x["k"]: x["c"] for x in df.select("k", text.collapse_repeats(F.col("t")).alias("c")).collect()} == {k: plain(t) for k, t in enumerate(texts)}


def test_word_distance_by_tables():
    rng = random.Random(5)
    for _ in range(300):
        x, y = ([rng.choice("abcdef") for _ in range(rng.choice((0, 1, 5, 63, 64, 65, 130)))] for _ in range(2))
        e, c = list(range(len(y) + 1)), [0] * (len(y) + 1)
        for i, w in enumerate(x, 1):
            f, d = [i], [0]
            for j, v in enumerate(y, 1):
                f.append(min(e[j] + 1, f[j - 1] + 1, e[j - 1] + (w != v)))
                d.append(c[j - 1] + 1 if w == v else max(c[j], d[j - 1]))
            e, c = f, d
        assert text.edits_and_common(x, y) == (e[-1], c[-1])


def test_word_distance_of_long_turns(spark, tmp_path):
    from chronoloom.plans import catalog

    words = [f"w{k}" for k in range(150)]
    rows = [(1, 0, "user", " ".join(words)), (1, 1, "bot", " ".join([*words[:100], "other", *words[101:], "more"]))]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in catalog.queries()["q_word_distance"](spark, str(tmp_path)).collect()] == [(1, 0, 2, 149)]


def test_aligned_words():
    assert text.align_words(["a", "B", "c"], ["x", "b", "y", "z", "c", "d"]) == (["x", "b", "c"], ["", "", "y z", "d"])
    assert text.align_words([], ["a", "b"]) == ([], ["a b"]) and text.align_words(["a"], []) == ([""], ["", ""])
    rng = random.Random(6)
    for _ in range(200):
        x, y = ([rng.choice("abcA") for _ in range(rng.randrange(9))] for _ in range(2))
        values, phrases = text.align_words(x, y)
        both = [w for k in range(len(x) + 1) for w in (*phrases[k].split(), *values[k : k + 1]) if w]
        cost = sum(v.casefold() != w.casefold() for v, w in zip(values, x, strict=True)) + sum(len(p.split()) for p in phrases)
        assert both == y and cost == text.edits_and_common([w.casefold() for w in x], [w.casefold() for w in y])[0]


def test_confusion_slots_of_whole_turns(spark, tmp_path):
    from chronoloom.plans import catalog

    words = [f"w{k}" for k in range(30)]
    rows = [(1, 0, "user", " "), (1, 1, "user", " ".join(words)), (1, 2, "bot", " ".join(["oh", *words[:20], "X", *words[21:]])), (2, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {(r["conv_id"], r["kind"], r["slot"], r["word"]): r["p"] for r in catalog.queries()["q_confusion_slots"](spark, str(tmp_path)).collect()}
    m = [math.exp(-k / 2) / sum(math.exp(-j / 2) for j in range(3)) for k in range(3)]
    expected = {(1, "word", k, w): m[1] + m[2] for k, w in enumerate(words)} | {(1, "word", k, ""): m[0] for k in range(30)}
    expected |= {(1, "word", 20, "w20"): m[1], (1, "word", 20, "X"): m[2], (1, "insert", 0, "oh"): m[2], (1, "insert", 0, ""): m[0] + m[1]}
    assert found == {k: pytest.approx(v, abs=2e-6) for k, v in expected.items()}


def test_calibration_keeps_probabilities_off_the_ends(spark):
    rows = [(0.0, 1), (1.0, 1), (0.25, 0), (0.35, 1)]  # each has a bin of its own
    got = M.calibration(frame(spark, rows, "p double, y int"), F.col("p"), F.col("y")).first()
    kept = [(min(max(p, 1e-6), 1 - 1e-6), y) for p, y in rows]
    assert got["brier"] == pytest.approx(sum((p - y) ** 2 for p, y in kept) / 4)
    assert got["nll"] == pytest.approx(-sum(math.log(p if y else 1 - p) for p, y in kept) / 4)
    assert got["ece"] == pytest.approx(sum(abs(p - y) for p, y in kept) / 4)


def test_degeneracy(spark):
    got = one(spark, *[text.degeneracy(F.lit(x)) for x in ("go on, go on,\nstop. [x]", "aab", "", None)])
    assert [tuple(r) for r in got] == [(4, pytest.approx(12 / 20), 1, pytest.approx(13 / 23), True), (1, None, 2, pytest.approx(2 / 3), False), (0, None, 0, None, False), (0, None, 0, None, False)]


def test_scores_in_answers(spark):
    said = {"0.8": (0.8, "bare_float"), " 7e-1 ": (0.7, "bare_float"), "The score is 3, the final score is 0.4.": (0.4, "sentence"), "score: 1; score = 2": (2.0, "sentence"), "about .5 .": (0.5, "trailing_number"), "none": (None, "unparsed"), " ": (None, "empty")}
    assert [tuple(r) for r in one(spark, *[text.parse_score(F.lit(s)) for s in said])] == list(said.values())
    scale = {0.4: (0.4, "in_range"), 4.0: (0.4, "div10"), 40.0: (0.4, "div100"), 400.0: (1.0, "clamped_high"), -1.0: (0.0, "clamped_low"), math.inf: (None, "nonfinite"), math.nan: (None, "nonfinite")}
    for got, (value, rule) in zip(one(spark, *[text.normalise_score(F.lit(s)) for s in scale]), scale.values(), strict=True):
        assert got["rule"] == rule and (got["value"] is None if value is None else got["value"] == pytest.approx(value))
    votes = F.create_map(F.lit(" Yes"), F.lit(-1.0), F.lit("x"), F.lit(-3.0))
    assert tuple(one(spark, text.yes_no_logodds(votes))[0]) == (2.0, "bounded")


def test_tiles_and_pixels(spark):
    box = lambda *e: F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(("x0", "y0", "x1", "y1"), e, strict=True)])
    got = one(spark, S.tiles(box(0, 0, 11, 5)), S.tiles(box(0, 0, 9, 5)), S.tiles(box(0, 0, 3, 9)), S.to_pixels(box(10, 20, 13, 27), box(0, 500, 500, 1000)))
    assert [[tuple(b) for b in x] for x in got[:3]] == [[(0, 0, 2, 5), (2, 0, 4, 5), (4, 0, 6, 5), (6, 0, 11, 5)], [(0, 0, 4, 2), (4, 0, 9, 2), (0, 2, 4, 5), (4, 2, 9, 5)], []]
    assert tuple(got[3]) == (10, 23, 12, 27)


def test_local_z_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), k, round(rng.random(), 2)) for k in range(60)]
    got = {r["k"]: r["z"] for r in R.local_z(frame(spark, rows, "g int, k int, x double"), "x", ["g"], 5).collect()}
    for g, k, x in rows:
        pool = sorted(v for h, _, v in rows if h == g)
        hi = min(len(pool), max(0, sum(v < x for v in pool) - 2) + 5)
        near = pool[max(0, hi - 5) : hi]
        mean = sum(near) / len(near)
        sd = math.sqrt(sum((v - mean) ** 2 for v in near) / len(near))
        if sd > 1e-6:
            assert got[k] == pytest.approx((x - mean) / sd, abs=1e-5)


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_group_rank_by_sorting(spark, parts):
    """Null keys and values, one group and one value with most rows, identical rows, more rows than are sampled."""
    rng = random.Random(5)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), rng.choice([1.0] * 6 + [-2.5, None, float("nan"), float(rng.randrange(50))]), k) for k in range(6000)]
    rows += [("c", 3.0, -1)] * 4
    order = lambda r: (r[1] is not None, r[1] != r[1], r[1] if r[1] is not None and r[1] == r[1] else 0.0, r[2])
    groups = {}
    for r in sorted(rows, key=order):
        groups.setdefault(r[0], []).append(r)
    expected = sorted((str(g), r[2], place, len(own)) for g, own in groups.items() for place, r in enumerate(own))
    got = R.group_rank(frame(spark, rows, "g string, s double, k int"), ["g"], ["s", "k"], "r", "n", parts=parts)
    assert got.columns == ["g", "s", "k", "r", "n"]
    assert sorted((str(r["g"]), r["k"], r["r"], r["n"]) for r in got.collect()) == expected
    assert R.group_rank(frame(spark, [], "g string, s double, k int"), ["g"], ["s", "k"]).collect() == []


def test_grouped_rank_metrics_in_ranges(spark, monkeypatch):
    """A hot group, groups of one class, a null group and ties, in windows of groups and in ranges of (group, score)."""
    import numpy as np

    from chronoloom.operators import metrics as M

    rng = np.random.default_rng(3)
    rows = [(1 if k % 3 else int(rng.integers(2, 9)), float(rng.integers(0, 150)), int(rng.random() < 0.3)) for k in range(3_000)]
    rows += [(None, float(k % 7), k % 2) for k in range(50)] + [(99, 1.0, 1), (99, 2.0, 1)]
    df = spark.createDataFrame(rows, "g bigint, s double, y int")
    found = []
    for together in (M.TOGETHER, 0):
        monkeypatch.setattr(M, "TOGETHER", together)
        found.append(sorted((str(r["g"]), r["auc"], r["ap"], r["base_rate"], r["n_pos"], r["n_neg"]) for r in M.rank_metrics(df, "s", "y", ["g"]).collect()))
    assert len(found[0]) == len(found[1]) == 10 and found[0] == [(*a[:1], pytest.approx(a[1]), pytest.approx(a[2]), *a[3:]) for a in found[1]]


def test_only_large_groups_are_taken_in_ranges(spark, monkeypatch):
    """Of many scores, groups of few are windows beside a large group's ranges; without a large group there are no ranges."""
    from chronoloom.operators import metrics as M

    r = random.Random(7)
    small = [(None if g == 3 else g, float(r.randrange(20)), int(r.random() < 0.4)) for g in range(12) for _ in range(60)]
    hot = [(50, float(r.randrange(300)), int(r.random() < 0.4)) for _ in range(900)]
    schema = "g bigint, s double, y int"
    metrics = lambda rows: {x["g"]: (x["auc"], x["ap"], x["base_rate"], x["n_pos"], x["n_neg"]) for x in M.rank_metrics(spark.createDataFrame(rows, schema), "s", "y", ["g"]).collect()}
    want = metrics(small + hot)
    calls, own = [], M.splitters
    monkeypatch.setattr(M, "splitters", lambda df, *a: calls.append({x["g"] for x in df.select("g").distinct().collect()}) or own(df, *a))
    monkeypatch.setattr(M, "TOGETHER", 200)
    found = metrics(small + hot)
    assert calls == [{50}] and found.keys() == want.keys() and len(want) == 13
    assert all(found[g] == pytest.approx(want[g], abs=1e-12) for g in want)
    assert metrics(small) == {g: v for g, v in want.items() if g != 50} and calls == [{50}]


def test_curves_of_long_tables(spark, sf, monkeypatch):
    from chronoloom.plans import frames

    before = sorted(map(tuple, frames.curve(spark, sf).collect()))
    monkeypatch.setattr(frames, "TOGETHER", 0)
    assert sorted(map(tuple, frames.curve(spark, sf).collect())) == before


@pytest.mark.parametrize("parts,together", [(1, 0), (5, 0), (64, 0), (64, 2_000_000)])
def test_percentiles_of_groups_in_ranges(spark, monkeypatch, parts, together):
    monkeypatch.setattr(quantiles, "TOGETHER", together)
    r = random.Random(parts)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0, 0.5]
    groups = {"hot": [r.random() for _ in range(300)] + [0.5] * 200, "one": [3.0], None: [1.0, 2.0], "ties": [7.0] * 9 + [8.0], "nan": [1.0, float("nan")], "nulls": [None, None], "mixed": [None, 4.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    found = {x["g"]: x["q"] for x in percentiles(df, "v", ["g"], shares, parts=parts).collect()}
    want = {x["g"]: x["q"] for x in df.where("v is not null").groupBy("g").agg(F.percentile("v", shares).alias("q")).collect()}
    assert found.keys() == want.keys() == groups.keys() - {"nulls"}
    for g, q in want.items():
        assert found[g] == pytest.approx(q, abs=1e-12, nan_ok=True)
    pooled = [x["q"] for x in percentiles(df.where("not isnan(v)"), "v", [], shares, parts=parts).collect()]
    assert len(pooled) == 1 and pooled[0] == pytest.approx(df.where("not isnan(v)").agg(F.percentile("v", shares)).first()[0], abs=1e-12)
    assert percentiles(df.where("v > 100 and not isnan(v)"), "v", ["g"], shares).count() == 0

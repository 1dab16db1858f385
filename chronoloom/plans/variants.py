"""Queries on joins that check lengths, rejects beside results, clause repetitions, and kinds of smoothing and pooling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import scalars as S
from chronoloom.functions import stats as T
from chronoloom.functions import text as X
from chronoloom.operators import graphs as G
from chronoloom.operators import grids
from chronoloom.operators import intervals as I
from chronoloom.operators import metrics as M
from chronoloom.operators.asof import asof
from chronoloom.operators.ranks import group_rank
from chronoloom.plans.catalog import query
from chronoloom.plans.frames import CURVE_SQL, FRAME_HOURS, GRID_SQL, SPANS_SQL, cells_sql, curve, grid, n_cells, ranked_curve, read, spans
from chronoloom.plans.metrics import _LIMITS, _rank_sql, _replicates_sql
from chronoloom.storage import stored
from chronoloom.sources import files

_SHORT = "SELECT gid, idx, y FROM (SELECT *, count(*) OVER (PARTITION BY gid) AS n FROM curve) WHERE idx < n - gid % 3"


@query(
    "q_truncated_join",
    f"""WITH {CURVE_SQL}, gold AS ({_SHORT}), a AS (SELECT gid, count(*) AS n_score FROM curve GROUP BY gid), b AS (SELECT gid, count(*) AS n_gold FROM gold GROUP BY gid)
    SELECT gid, idx, s, g.y, n_score, n_gold FROM curve c JOIN gold g USING (gid, idx) JOIN a USING (gid) JOIN b USING (gid) WHERE isfinite(s)""",
)
def truncated_join(spark, sf):
    """Scores and labels of a series up to the shorter one's length, with both lengths."""
    c = stored(ranked_curve(spark, sf), "curve")
    gold = c.where(F.col("idx") < F.col("n") - F.col("gid") % 3).select("gid", "idx", "y")
    return grids.truncated(c.select("gid", "idx", "s"), gold, "gid", "idx").where(~F.isnan("s") & (F.abs("s") < float("inf")))


@query("q_equal_grids", f"WITH {CURVE_SQL} SELECT gid, count(*) AS n FROM curve WHERE gid IN (SELECT gid FROM curve WHERE y = 1) GROUP BY gid")
def equal_grids(spark, sf):
    """Series that all runs have, once their lengths are known to agree."""
    c = curve(spark, sf)
    hit = c.where("y = 1").select("gid").distinct()
    return grids.equal([c, c.join(hit, "gid", "left_semi")], "gid")



@query("q_pooled_by_group_mean", f"WITH {CURVE_SQL}, halves AS (SELECT gid, floor(t / 24)::BIGINT AS day, max(y) AS y, avg(s) AS s FROM curve GROUP BY ALL), {_rank_sql('halves', '')} SELECT round(auc, 9) AS auc, round(ap, 9) AS ap FROM r")
def pooled_by_group_mean(spark, sf):
    """Ranking metrics of the mean score of each user's day."""
    days = curve(spark, sf).groupBy("gid", F.floor(F.col("t") / 24).alias("day")).agg(F.max("y").alias("y"), F.avg("s").alias("s"))
    return M.rank_metrics(days, "s", "y").select(F.round("auc", 9).alias("auc"), F.round("ap", 9).alias("ap"))


@query(
    "q_chunk_curve",
    f"""WITH {SPANS_SQL}, n AS (SELECT len({cells_sql(FRAME_HOURS)}) AS n), c AS (SELECT gid, v, greatest(floor(start / 4)::BIGINT, 0) AS lo, "end" FROM spans), k AS (SELECT gid, v, lo, least(n, greatest(lo + 1, ceil("end" / 4)::BIGINT)) AS hi FROM c, n),
    x AS (SELECT gid, unnest(range(lo, hi)) AS frame, v FROM k), m AS (SELECT gid, frame, avg(v) AS v FROM x GROUP BY ALL) SELECT u.gid, f.frame, round(coalesce(v, -12), 6) AS v FROM (SELECT DISTINCT gid FROM curve) u, (SELECT unnest(range(n)) AS frame FROM n) f LEFT JOIN m ON m.gid = u.gid AND m.frame = f.frame""",
)
def chunk_curve(spark, sf):
    """Mean of the chunks over each frame, at least one frame a chunk, -12 where there is none."""
    n = n_cells(spark, sf, FRAME_HOURS)
    return grids.chunk_curve(spans(spark, sf), curve(spark, sf).select("gid").distinct(), n, 1 / FRAME_HOURS, -12.0).select("gid", "frame", F.round("v", 6).alias("v"))


@query("q_bootstrap_row_difference", f"WITH {CURVE_SQL}, scored AS (SELECT * FROM curve), g AS (SELECT event_id AS gid FROM curve), {T.weights_sql('g', 60)}, {_replicates_sql('s', 'scored.event_id', 'a', 60)}, {_replicates_sql('t', 'scored.event_id', 'b', 60)}, m AS (SELECT a.auc - b.auc AS v FROM a JOIN b USING (r)) SELECT {_LIMITS}, round(avg((v <= 0)::INT), 9) AS not_better FROM m")
def bootstrap_row_difference(spark, sf):
    """Interval of the difference of two scores' AUC when rows are resampled."""
    return T.bootstrap_difference(curve(spark, sf), "s", "t", "y", "event_id", 60)


SIGMA, RADIUS = 2.0, 8


@query(
    "q_probability_smooth",
    f"""WITH {CURVE_SQL}, p AS (SELECT gid, idx, 1 / (1 + exp(-(s - 50) / 20)) AS p, count(*) OVER (PARTITION BY gid) AS n FROM curve), w AS (SELECT k, exp(-0.5 * k * k / {SIGMA**2}) / (SELECT sum(exp(-0.5 * j * j / {SIGMA**2})) FROM range(-{RADIUS}, {RADIUS + 1}) r(j)) AS w FROM range(-{RADIUS}, {RADIUS + 1}) t(k)),
    a AS (SELECT gid, idx, w, n, (idx + k + 20 * n) % (2 * n) AS m FROM p, w), b AS (SELECT gid, idx, w, CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END AS src FROM a) SELECT b.gid, b.idx, round(sum(w * p.p), 9) AS v FROM b JOIN p ON p.gid = b.gid AND p.idx = b.src GROUP BY ALL""",
)
def probability_smooth(spark, sf):
    """Chances smoothed by a Gaussian, series mirrored at their ends."""
    c = ranked_curve(spark, sf).select("gid", "idx", "n", S.sigmoid((F.col("s") - 50) / 20).alias("p"))
    return grids.mirrored_smooth(c, "p", SIGMA, RADIUS).select("gid", "idx", F.round("v", 9).alias("v"))


_LAMBDAS = [round(-2 + k * 0.05, 10) for k in range(81)]


@query(
    "q_signed_power",
    f"""WITH {CURVE_SQL}, x AS (SELECT (s - 50) / 20 AS x FROM curve), l AS (SELECT unnest(range(81)) AS k, unnest({_LAMBDAS}::DOUBLE[]) AS lam),
    y AS (SELECT k, lam, CASE WHEN x >= 0 AND abs(lam) < 1e-9 THEN ln(x + 1) WHEN x >= 0 THEN (pow(x + 1, lam) - 1) / lam WHEN abs(lam - 2) < 1e-9 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - lam) - 1) / (2 - lam) END AS y, sign(x) * ln(abs(x) + 1) AS j FROM x, l),
    f AS (SELECT k, lam, -count(*) / 2.0 * ln(var_pop(y)) + (lam - 1) * sum(j) AS f FROM y GROUP BY k, lam) SELECT round(arg_max(lam, (round(f, 3), -k)), 6)::DOUBLE AS lambda FROM f""",
)
def signed_power(spark, sf):
    """Yeo-Johnson power of greatest likelihood for values of either sign; all powers in one pass."""
    x = (F.col("s") - 50) / 20

    def moved(a: float):
        up = F.log(x + 1) if abs(a) < 1e-9 else (F.pow(x + 1, F.lit(a)) - 1) / a
        down = -F.log(1 - x) if abs(a - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - a)) - 1) / (2 - a)
        return F.when(x >= 0, up).otherwise(down)

    r = curve(spark, sf).agg(F.count("*").alias("n"), F.sum(F.signum(x) * F.log(F.abs(x) + 1)).alias("j"), *[F.var_pop(moved(a)).alias(f"v{k}") for k, a in enumerate(_LAMBDAS)]).first()
    fit = [round(-r["n"] / 2 * math.log(r[f"v{k}"]) + (a - 1) * r["j"], 3) for k, a in enumerate(_LAMBDAS)]
    return spark.createDataFrame([(_LAMBDAS[max(range(81), key=lambda k: (fit[k], -k))],)], "lambda double")


@query("q_collapse_clauses")
def collapse_clauses(spark, sf):
    """Clauses of a document without immediate repetitions, with their places."""
    d = read(spark, sf, "documents").select("doc_id", X.collapse_clauses(F.col("text")).alias("c"))
    said = F.transform("c", lambda x: F.concat_ws(":", x["key"], x["start"].cast("string"), x["end"].cast("string")))
    return d.select("doc_id", F.size("c").alias("n"), F.md5(F.array_join(said, "|")).alias("digest"))


def _cells(spark, sf) -> DataFrame:
    """Cells of clock pairs as people write them: good ones, a word for a time, one time alone, a pair turned round, no list at all, none."""
    i, m = F.col("event_id"), (F.col("event_id") % 60).cast("string")
    clock = lambda k: F.format_string("%02d:%02d", (i + k) % 60, (i * 7) % 60)
    pair = F.concat(F.lit("['"), clock(0), F.lit("', '"), F.concat(F.lit("1:"), clock(0)), F.lit("']"))
    cases = [F.concat(F.lit("["), pair, F.lit(", ['"), m, F.lit("', 'end']]")), F.concat(F.lit("["), pair, F.lit(", ["), m, F.lit("]]")), F.concat(F.lit("[[\"9\", \"3\"], "), pair, F.lit("]")), F.concat(F.lit("see "), m), F.lit("")]
    return read(spark, sf, "events").select("event_id", F.get(F.array(*cases), (i % 5).cast("int")).alias("cell"))


@query(
    "q_span_rejects",
    """WITH e AS (SELECT event_id, event_id % 5 AS c, (event_id % 60) * 60 + (event_id * 7) % 60 AS s, (event_id % 60)::VARCHAR AS m FROM events)
    SELECT event_id, s::DOUBLE AS start, (s + 3600)::DOUBLE AS "end", NULL AS reason FROM e WHERE c < 3
    UNION ALL SELECT event_id, NULL, NULL, CASE c WHEN 0 THEN 'unparseable_time:[''' || m || ''', ''end'']' WHEN 1 THEN 'malformed_pair:[' || m || ']' WHEN 2 THEN 'non_positive_duration:["9", "3"]' ELSE 'unparseable_cell' END FROM e WHERE c < 4""",
)
def span_rejects(spark, sf):
    """Spans of cells, and what gave none with the reason, from one parse."""
    good, bad = files.parted(_cells(spark, sf), "event_id", X.parse_snippet(F.col("cell")))
    none = F.lit(None).cast("double")
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.select("event_id", none.alias("start"), none.alias("end"), "reason"))


@query(
    "q_list_rejects",
    """WITH o AS (SELECT o_orderkey, o_custkey % 4 AS c, o_totalprice AS p FROM orders) SELECT o_orderkey, CASE WHEN c = 0 THEN NULL ELSE unnest([0, 1]) END AS position, CASE c WHEN 0 THEN 'lengths:a=2,b=1' END AS reason FROM o WHERE c IN (1, 2)
    UNION ALL SELECT o_orderkey, NULL, CASE c WHEN 0 THEN 'lengths:a=2,b=1' ELSE 'missing:b' END FROM o WHERE c IN (0, 3)""",
)
def list_rejects(spark, sf):
    """Positions of parallel lists of equal length, and the rows whose lists are not."""
    c = F.col("o_custkey") % 4
    o = read(spark, sf, "orders").select("o_orderkey", F.array("o_totalprice", "o_totalprice").alias("a"), F.when(c == 0, F.array("o_custkey")).when(c < 3, F.array("o_custkey", "o_custkey")).alias("b"))
    good, bad = files.even_lists(o, "o_orderkey", ["a", "b"])
    return good.select("o_orderkey", "position", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("o_orderkey", F.lit(None).cast("int").alias("position"), "reason"))


@query(
    "q_rerank_distinct",
    """WITH i AS (SELECT min(vec_id) AS vec_id, min(label) AS label, embedding::DOUBLE[] AS e FROM (SELECT vec_id, label, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000000, label, embedding FROM embeddings) GROUP BY embedding), q AS (SELECT vec_id AS qid, label AS ql, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
    p AS (SELECT qid, ql, i.vec_id, label, round(list_dot_product(q.e, i.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(i.e, i.e)), 9) AS c FROM q, i WHERE qid <> vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, vec_id) AS r FROM p),
    s AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY round(0.7 * c + 0.3 * (label = ql)::INT, 9) DESC, vec_id) AS k FROM r WHERE r <= 20) SELECT qid, vec_id, k FROM s WHERE k <= 5""",
)
def rerank_distinct(spark, sf):
    """As the rerank, over an index in which equal vectors are one item under their smallest id; every vector stands twice in what is indexed."""
    e = read(spark, sf, "embeddings")
    twice = e.unionByName(e.withColumn("vec_id", F.col("vec_id") + 1_000_000_000))
    index = grids.distinct_items(twice, "vec_id", "embedding")
    c = G.cosine_topk(e.where("vec_id % 50 = 0"), index, 20).join(index.select("vec_id", "label"), "vec_id").join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("own")), "qid")
    score = F.round(0.7 * F.col("cosine") + 0.3 * (F.col("label") == F.col("own")).cast("int"), 9)
    best = c.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-score).alias("d"), "vec_id"))), 1, 5).alias("l"))  # twenty candidates a query
    return best.select("qid", F.posexplode("l").alias("k", "x")).select("qid", F.col("x.vec_id").alias("vec_id"), (F.col("k") + 1).cast("long").alias("k"))


@query("q_between_class", f"WITH {CURVE_SQL}, c AS (SELECT event_type, avg(s) AS cut FROM curve GROUP BY event_type), x AS (SELECT event_type, count(*) FILTER (s < cut) AS n0, count(*) FILTER (s >= cut) AS n1, avg(s) FILTER (s < cut) AS m0, avg(s) FILTER (s >= cut) AS m1 FROM curve JOIN c USING (event_type) GROUP BY event_type) SELECT event_type, round(n0 * n1 / pow(n0 + n1, 2) * pow(m0 - m1, 2), 6) AS score FROM x")
def between_class(spark, sf):
    """Between-class variance of each type's scores cut at their mean."""
    return grids.between_class(curve(spark, sf), "s", "event_type").select("event_type", F.round("score", 6).alias("score"))


@query(
    "q_pair_fallback",
    """WITH e AS (SELECT event_id, event_id % 5 AS c, (event_id % 90)::DOUBLE AS a, event_id % 90 + 2.5 AS b FROM events) SELECT event_id, a AS start, b AS "end" FROM e WHERE c < 3 UNION ALL SELECT event_id, b, a FROM e WHERE c = 0""",
)
def pair_fallback(spark, sf):
    """Pairs of answers: two in round brackets, one among square ones that then don't count, one in square brackets alone, and texts that hold none."""
    i = F.col("event_id")
    a, b = (i % 90).cast("string"), (i % 90 + F.lit(2.5)).cast("string")
    both = F.concat(a, F.lit(" , "), b)
    cases = [F.concat(F.lit("from ("), both, F.lit(") to ("), b, F.lit(","), a, F.lit(")")), F.concat(F.lit("[7, 8] ("), both, F.lit(")")), F.concat(F.lit("\n[ "), both, F.lit("] ")), F.concat(F.lit("at ["), both, F.lit("]")), F.concat(F.lit("(-"), both, F.lit(")"))]
    e = read(spark, sf, "events").select("event_id", F.explode(X.parse_pairs(F.get(F.array(*cases), (i % 5).cast("int")))).alias("s"))
    return e.select("event_id", "s.start", "s.end")


_SIZES_SQL = "sizes AS (SELECT gid, max(t) AS duration FROM curve GROUP BY gid)"


@query(
    "q_floor_raster",
    f"""WITH {SPANS_SQL}, {_SIZES_SQL}, k AS (SELECT gid, greatest(least("end", duration), start) AS stop, greatest(start, 0) AS start FROM spans JOIN sizes USING (gid)), f AS (SELECT gid, unnest(range(greatest(floor(duration / 4)::BIGINT, 1))) AS frame FROM sizes),
    h AS (SELECT DISTINCT gid, unnest(range(greatest(floor(start / 4)::BIGINT, 0), ceil(stop / 4)::BIGINT + 1)) AS frame, start, stop FROM k) SELECT gid, frame, max((start IS NOT NULL AND frame / 0.25::DOUBLE >= start AND frame / 0.25::DOUBLE < stop)::INT) AS y FROM f LEFT JOIN h USING (gid, frame) GROUP BY ALL""",
)
def floor_raster(spark, sf):
    """Frames of each series' own length, rounded down, that lie in a span."""
    sizes = curve(spark, sf).groupBy("gid").agg(F.max("t").alias("duration"))
    return grids.floor_raster(spans(spark, sf), sizes, 1 / FRAME_HOURS)


@query(
    "q_clipped_spans",
    f"""WITH {SPANS_SQL}, {_SIZES_SQL}, k AS (SELECT gid, greatest(start, 0) AS start, least("end", duration) AS stop FROM spans JOIN sizes USING (gid) WHERE least("end", duration) > greatest(start, 0)),
    m AS (SELECT *, max(stop) OVER (PARTITION BY gid ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k), n AS (SELECT *, sum((before IS NULL OR start > before + 1e-9)::INT) OVER (PARTITION BY gid ORDER BY start, stop) AS island FROM m)
    SELECT gid, round(min(start), 6) AS start, round(max(stop), 6) AS "end" FROM n GROUP BY gid, island""",
)
def clipped_spans(spark, sf):
    """Spans clipped to their series and merged where they touch."""
    sizes = curve(spark, sf).groupBy("gid").agg(F.max("t").alias("duration"))
    return I.merged(grids.clipped(spans(spark, sf), sizes), 1e-9).select("gid", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(
    "q_position_graph",
    """WITH x AS (SELECT label AS gid, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, count(*) OVER (PARTITION BY label) AS n, embedding::DOUBLE[] AS e FROM embeddings), z AS (SELECT gid, idx, n, idx // 20 AS block, e, sqrt(list_dot_product(e, e)) + 1e-6 AS l FROM x),
    p AS (SELECT a.gid, a.idx AS i, b.idx AS j, b.block, greatest(3, 8 - a.block * 20 // greatest(1, a.n // 10)) AS k, (0.75 * list_dot_product(a.e, b.e) / (a.l * b.l) + 0.25 * exp(-sqrt(pow(a.e[1] - b.e[1], 2) + pow(a.e[2] - b.e[2], 2)))) / (1 + 0.6 * abs(a.idx - b.idx) / 4) AS w FROM z a JOIN z b USING (gid)),
    r AS (SELECT *, row_number() OVER (PARTITION BY gid, i, block ORDER BY round(w, 12) DESC, j) AS r FROM p) SELECT gid, least(i, j) AS a, greatest(i, j) AS b, round(max(w), 9) AS w FROM r WHERE r <= k AND w > 0 AND i <> j GROUP BY ALL""",
)
def position_graph(spark, sf):
    """Similar vectors of a label in the order of their ids: the best of each block of 20, fewer towards the end."""
    e = read(spark, sf, "embeddings").select(F.col("label").alias("gid"), "vec_id", F.col("embedding").alias("look"), F.slice("embedding", 1, 2).alias("motion"))
    items = group_rank(e, ["gid"], ["vec_id"], "idx")
    return G.position_graph(items, 20, 8, 3, 0.75, 0.6 / 4, digits=9)


_TURNS = "conv_id, turn, text, CASE WHEN turn % 7 <> 3 THEN turn * 10.0::DOUBLE END AS s, CASE WHEN turn % 3 <> 0 THEN turn * 10.0::DOUBLE + turn % 4 * 5 END AS e, CASE WHEN conv_id % 3 = 0 THEN 35.0::DOUBLE WHEN conv_id % 3 = 1 THEN 0.0::DOUBLE END AS d"


@query(
    "q_timed_chunks",
    f"""WITH c AS (SELECT {_TURNS}, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations), k AS (SELECT *, last_value(coalesce(e, nullif(d, 0), s) IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
    f AS (SELECT conv_id AS video_id, position, coalesce(s, before, 0.0) AS start, text, e, d FROM k), g AS (SELECT *, coalesce(e, nullif(d, 0), start) AS "end" FROM f) SELECT video_id, position, start, "end", length(text) AS n FROM g WHERE "end" > start""",
)
def timed_chunks(spark, sf):
    """Turns as transcripts whose chunks lack starts, ends or the duration."""
    t = F.col("turn")
    chunk = F.struct("turn", F.when(t % 7 != 3, t * 10.0).alias("start"), F.when(t % 3 != 0, t * 10.0 + t % 4 * 5).alias("end"), "text")
    records = read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    d = F.when(F.col("video_id") % 3 == 0, 35.0).when(F.col("video_id") % 3 == 1, 0.0)
    return files.timed_chunks(records.withColumn("wav_duration", d)).select("video_id", "position", "start", "end", F.length("text").alias("n"))


@query(
    "q_clipped_pieces",
    """WITH c AS (SELECT conv_id, turn, text, turn * 10.0::DOUBLE AS s, turn * 10.0::DOUBLE + 4 + turn % 4 * 3 AS e FROM conversations WHERE text <> ''), x AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '') AS ws, unnest(range(floor(s / 12)::BIGINT, ceil(e / 12)::BIGINT)) AS w FROM c),
    p AS (SELECT conv_id, turn, w, greatest(s, w * 12) AS start, least(e, w * 12 + 12) AS "end", CASE WHEN s >= w * 12 AND e <= w * 12 + 12 THEN text ELSE array_to_string(list_slice(ws, round_even(len(ws) * (greatest(s, w * 12) - s) / (e - s), 0)::INT + 1, round_even(len(ws) * (least(e, w * 12 + 12) - s) / (e - s), 0)::INT), ' ') END AS text FROM x)
    SELECT conv_id, turn, w, start, "end", text FROM p WHERE text <> ''""",
)
def clipped_pieces(spark, sf):
    """Pieces of the turns in windows of twelve seconds, with clipped times; a turn inside a window is kept as it is."""
    t = F.col("turn")
    c = read(spark, sf, "conversations").select("conv_id", "turn", "text", (t * 10.0).alias("s"), (t * 10.0 + 4 + t % 4 * 3).alias("e"))
    w = F.col("w")
    x = c.withColumn("w", F.explode(F.sequence(F.floor(F.col("s") / 12), F.ceil(F.col("e") / 12) - 1)))
    return x.select("conv_id", "turn", "w", X.clipped_piece(F.col("text"), w * 12.0, w * 12.0 + 12, F.col("s"), F.col("e")).alias("p")).where("p is not null").select("conv_id", "turn", "w", "p.*")


@query(
    "q_span_of_midpoint",
    f"""WITH {SPANS_SQL}, {GRID_SQL}, n AS (SELECT DISTINCT gid FROM spans) SELECT grid.gid, frame, greatest((SELECT count(*) FROM spans s WHERE s.gid = grid.gid AND s.start <= t + 2) - 1, 0) AS at FROM grid JOIN n USING (gid)""",
)
def span_of_midpoint(spark, sf):
    """Number of the last span that begins at or before the middle of each frame; the first before all, the last behind all."""
    s = spans(spark, sf)
    points = grid(spark, sf).select("gid", "frame", (F.col("t") + FRAME_HOURS / 2).alias("t"))
    found = asof(points.join(s.select("gid").distinct(), "gid", "left_semi"), s.select("gid", F.col("start").alias("t"), F.col("ord").alias("v")), 24.0)
    return found.select("gid", "frame", F.coalesce(F.col("found.v").cast("long"), F.lit(0)).alias("at"))

"""Queries on clauses, aligned words, parsed answers, boxes and retrieval steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.functions import scalars as S
from chronoloom.functions import text as X
from chronoloom.operators import graphs as G
from chronoloom.operators import intervals as I
from chronoloom.operators.quantiles import percentiles
from chronoloom.plans.catalog import query
from chronoloom.plans.frames import CURVE_SQL, DURATION_SQL, FRAME_HOURS, SPANS_SQL, cells_sql, curve, duration, grid, read, spans


@query("q_clause_offsets", r"WITH c AS (SELECT item_id, text, regexp_extract_all(text, '[^.,;!?\n]+[.,;!?\n]*') AS cs FROM benchmark), p AS (SELECT item_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM c) SELECT item_id, i::INT AS i, coalesce(sum(length(c)) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(c)::BIGINT AS n FROM p")
def clause_offsets(spark, sf):
    """Clauses with their ends' punctuation, and where they begin counted from the first."""
    c = read(spark, sf, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.,;!?\n]+[.,;!?\n]*"), F.lit(0))).alias("k", "c"))
    before = W.partitionBy("item_id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    return c.select("item_id", (F.col("k") + 1).alias("i"), F.coalesce(F.sum(F.length("c")).over(before), F.lit(0)).cast("long").alias("start"), F.length("c").cast("long").alias("n"))


@query("q_atomic_pieces", f"WITH {SPANS_SQL}, p AS (SELECT gid, round(start, 6) AS p FROM spans UNION SELECT gid, round(\"end\", 6) FROM spans), n AS (SELECT gid, p AS start, lead(p) OVER (PARTITION BY gid ORDER BY p) AS \"end\" FROM p) SELECT * FROM n WHERE \"end\" IS NOT NULL")
def atomic_pieces(spark, sf):
    """Pieces between all distinct ends of a group's spans."""
    s = spans(spark, sf)
    p = s.select("gid", F.round("start", 6).alias("p")).union(s.select("gid", F.round("end", 6))).distinct()
    return p.select("gid", F.col("p").alias("start"), F.lead("p").over(W.partitionBy("gid").orderBy("p")).alias("end")).where("end is not null")


@query("q_words_by_midpoint", f"WITH {CURVE_SQL}, w AS (SELECT gid, idx, event_type AS w, t, coalesce(lead(t) OVER (PARTITION BY gid ORDER BY idx), t + 1) AS e FROM curve) SELECT gid, floor((t + e) / 2 / 96)::BIGINT AS w, string_agg(w, ' ' ORDER BY idx) AS said, round(min(t), 6) AS start, round(max(e), 6) AS \"end\" FROM w GROUP BY gid, floor((t + e) / 2 / 96)")
def words_by_midpoint(spark, sf):
    """Timed words in the window that holds their middle, with the clipped times."""
    end = F.coalesce(F.lead("t").over(W.partitionBy("gid").orderBy("idx")), F.col("t") + 1)
    w = curve(spark, sf).withColumn("e", end)
    g = w.groupBy("gid", F.floor((F.col("t") + F.col("e")) / 2 / 96).alias("w")).agg(F.array_sort(F.collect_list(F.struct("idx", "event_type"))).alias("l"), F.round(F.min("t"), 6).alias("start"), F.round(F.max("e"), 6).alias("end"))
    return g.select("gid", "w", F.array_join(F.transform("l", lambda x: x["event_type"]), " ").alias("said"), "start", "end")


@query(
    "q_normalised_raster",
    f"""WITH {SPANS_SQL}, n AS (SELECT gid, ord, start / {DURATION_SQL} AS a, "end" / {DURATION_SQL} AS b FROM spans), c AS (SELECT gid, ord, greatest(least(a, 1), 0) AS a, greatest(least(b, 1), 0) AS b, concat_ws(',', CASE WHEN a < 0 OR b > 1 THEN 'clamped' END, CASE WHEN a >= 1 THEN 'outside' END) AS flags FROM n)
    SELECT gid, ord, flags, floor(a * 200)::BIGINT AS first, greatest(ceil(b * 200 - 1e-9), floor(a * 200) + 1)::BIGINT AS past FROM c""",
)
def normalised_raster(spark, sf):
    """Intervals in shares of the duration to frames, at least one, and flags of what had to be changed."""
    whole = duration(spark, sf) or 1.0
    a, b = F.col("start") / whole, F.col("end") / whole
    clamp = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    flags = F.concat_ws(",", F.when((a < 0) | (b > 1), "clamped"), F.when(a >= 1, "outside"))
    first = F.floor(clamp(a) * 200)
    return spans(spark, sf).select("gid", "ord", flags.alias("flags"), first.alias("first"), F.greatest(F.ceil(clamp(b) * 200 - 1e-9), first + 1).alias("past"))


@query("q_numbered_intervals", f"WITH {CURVE_SQL} SELECT gid, idx, round(t, 6) AS start, round(t + 2 * {FRAME_HOURS}, 6) AS \"end\" FROM curve WHERE y = 0")
def numbered_intervals(spark, sf):
    """Answers that name numbered frames, as JSON; rows that don't parse, name no frame or are reversed are dropped."""
    c = curve(spark, sf)
    said = F.when(F.col("y") == 0, F.concat(F.lit('[{"first": '), F.col("idx").cast("string"), F.lit(', "last": '), (F.col("idx") + 1).cast("string"), F.lit("}, "), F.lit('{"first": 9, "last": 2}]'))).otherwise("nothing there")
    parsed = c.select("gid", "idx", "t", F.explode(F.coalesce(F.from_json(said, "array<struct<first:int,last:int>>"), F.array().cast("array<struct<first:int,last:int>>"))).alias("x")).where("x.first <= x.last")
    return parsed.select("gid", "idx", F.round("t", 6).alias("start"), F.round(F.col("t") + (F.col("x.last") - F.col("x.first") + 1) * FRAME_HOURS, 6).alias("end"))


@query(
    "q_box_mapping",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity * 20)::BIGINT AS w, floor(l_extendedprice / 100)::BIGINT AS h, round(l_discount * 1000)::BIGINT AS x, round(l_tax * 1000)::BIGINT AS y FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, 10 + x * w // 1000 AS x0, 5 + y * h // 1000 AS y0, 10 + ((x + 100) * w + 999) // 1000 AS x1, 5 + ((y + 250) * h + 999) // 1000 AS y1 FROM b""",
)
def box_mapping(spark, sf):
    """A box in thousandths of its parent to whole pixels, low ends down and high ends up."""
    box = lambda *ends: F.struct(*[e.cast("long").alias(c) for c, e in zip(("x0", "y0", "x1", "y1"), ends, strict=True)])
    parent = box(F.lit(10), F.lit(5), 10 + F.col("l_quantity") * 20, 5 + F.floor(F.col("l_extendedprice") / 100))
    x, y = F.round(F.col("l_discount") * 1000), F.round(F.col("l_tax") * 1000)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.to_pixels(parent, box(x, y, x + 100, y + 250)).alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", "b.*")


@query("q_validated_labels", "SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END || CASE toxic WHEN 1 THEN '+toxic' ELSE '' END AS label FROM labels")
def validated_labels(spark, sf):
    """Codes to names; a code outside its list is an error."""
    q, t = F.col("quality"), F.col("toxic")
    wrong = F.raise_error(F.concat(F.lit("unknown label of "), F.col("doc_id").cast("string"))).cast("string")
    name = F.when(q == 1, "good").when(q == 0, "bad").otherwise(wrong)
    return read(spark, sf, "labels").select("doc_id", F.concat(name, F.when(t == 1, "+toxic").when(t == 0, "").otherwise(wrong)).alias("label"))


@query("q_rule_band", f"WITH {CURVE_SQL}, p AS (SELECT event_id, event_type, 1 / (1 + exp(-(s - 50) / 20)) AS p FROM curve), m AS (SELECT median(p) AS m FROM p WHERE p BETWEEN 0.3 AND 0.9) SELECT event_id, CASE WHEN p BETWEEN 0.3 AND 0.9 AND p >= m THEN (event_type = 'error')::INT ELSE (p >= 0.5)::INT END AS v FROM p, m")
def rule_band(spark, sf):
    """Inside the upper half of an uncertain band a judge decides, elsewhere the score does."""
    from chronoloom.functions import scalars as S

    p = curve(spark, sf).select("event_id", "event_type", S.sigmoid((F.col("s") - 50) / 20).alias("p"))
    middle = percentiles(p.where("p between 0.3 and 0.9"), "p", [], [0.5]).first()
    m = middle["q"][0] if middle else None
    band = F.col("p").between(0.3, 0.9) & (F.col("p") >= F.lit(m).cast("double"))
    return p.select("event_id", F.when(band, (F.col("event_type") == "error").cast("int")).otherwise((F.col("p") >= 0.5).cast("int")).alias("v"))


@query("q_neighbour_expansion", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id AS qid, v.vec_id, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 9) AS c FROM v q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, vec_id) AS r FROM p), x AS (SELECT DISTINCT qid, vec_id + d AS vec_id FROM r, range(-1, 2) t(d) WHERE r <= 2) SELECT x.qid, x.vec_id FROM x SEMI JOIN v USING (vec_id) WHERE x.vec_id <> x.qid")
def neighbour_expansion(spark, sf):
    """The two best matches of a query and what stands next to them."""
    e = read(spark, sf, "embeddings")
    near = G.cosine_topk(e.where("vec_id % 50 = 0"), e, 2).select("qid", F.explode(F.sequence(F.col("vec_id") - 1, F.col("vec_id") + 1)).alias("vec_id")).distinct()
    return near.where("vec_id != qid").join(e.select("vec_id"), "vec_id", "left_semi").select("qid", "vec_id")


@query("q_rerank", "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id AS qid, v.vec_id, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 9) AS c, v.label = q.label AS own FROM v q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, vec_id) AS r FROM p), s AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY round(0.7 * c + 0.3 * own::INT, 9) DESC, vec_id) AS k FROM r WHERE r <= 20) SELECT qid, vec_id, k::INT AS k FROM s WHERE k <= 5")
def rerank(spark, sf):
    """Twenty candidates by one similarity, five of them by a mixed one."""
    e = read(spark, sf, "embeddings")
    c = G.cosine_topk(e.where("vec_id % 50 = 0"), e, 20).join(e.select("vec_id", "label"), "vec_id").join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("own")), "qid")
    score = F.round(0.7 * F.col("cosine") + 0.3 * (F.col("label") == F.col("own")).cast("int"), 9)
    return c.select("qid", "vec_id", F.row_number().over(W.partitionBy("qid").orderBy(score.desc(), "vec_id")).alias("k")).where("k <= 5")


@query("q_greedy_vector_pairs")
def greedy_vector_pairs(spark, sf):
    """Vectors of the first half of a block paired with those of its second half, greedily from the greatest cosine; blocks have 64 vectors."""
    e = read(spark, sf, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 64).alias("block"))

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        x = np.array(pdf["embedding"].tolist(), dtype=float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        ids, half = pdf["vec_id"].to_numpy(), len(pdf) // 2
        cos = np.round(x[:half] @ x[half:].T, 9)
        out, left, right = [], set(), set()
        for k in np.argsort(-cos, axis=None, kind="stable"):
            i, j = divmod(int(k), cos.shape[1])
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                out.append((int(ids[i]), int(ids[half + j]), round(float(cos[i, j]), 6)))
        return pd.DataFrame(out, columns=["a", "b", "cosine"])

    return e.groupBy("block").applyInPandas(pairs, "a bigint, b bigint, cosine double")


@query("q_softmax_refine", f"WITH {CURVE_SQL}, b AS (SELECT a.gid, a.idx, arg_max(c.idx, (c.s, -c.idx)) AS best FROM curve a JOIN curve c ON c.gid = a.gid AND c.idx BETWEEN a.idx - 1 AND a.idx + 1 GROUP BY ALL) SELECT b.gid, b.idx, round(sum(s * exp((s - 50) / 10)) / sum(exp((s - 50) / 10)), 6) AS v FROM b JOIN curve c ON c.gid = b.gid AND c.idx BETWEEN best - 2 AND best + 2 GROUP BY b.gid, b.idx")
def softmax_refine(spark, sf):
    """Each score becomes the softmax-weighted mean of its neighbourhood, centred on the best neighbour within one position."""
    o = W.partitionBy("gid").orderBy("idx")
    around = F.array_compact(F.array(*[F.lag("s", d).over(o) for d in range(-2, 3)]))
    best = -F.max(F.struct(F.col("s"), (-F.col("idx")).alias("i"))).over(o.rowsBetween(-1, 1))["i"]
    c = curve(spark, sf).select("gid", "idx", best.alias("best"), around.alias("around"))
    sums = F.aggregate("around", F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("z")), lambda x, s: F.struct((x["a"] + s * F.exp((s - F.array_max("around")) / 10)).alias("a"), (x["z"] + F.exp((s - F.array_max("around")) / 10)).alias("z")), lambda x: x["a"] / x["z"])
    c = c.select("gid", "idx", (F.col("best") - F.col("idx")).alias("step"), sums.alias("m"))
    chosen = F.when(F.col("step") < 0, F.lag("m").over(o)).when(F.col("step") > 0, F.lead("m").over(o)).otherwise(F.col("m"))
    return c.select("gid", "idx", F.round(chosen, 6).alias("v"))


@query("q_closure", f"WITH {SPANS_SQL}, m0 AS (SELECT *, max(\"end\") OVER (PARTITION BY gid ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans), m1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY gid ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS k FROM m0), m AS (SELECT gid, min(start) AS a, max(\"end\") AS b FROM m1 GROUP BY gid, k), c AS (SELECT gid, arg_max((start + \"end\") / 2, (v, -ord)) AS centre FROM spans GROUP BY gid) SELECT gid, round(a, 6) AS start, round(b, 6) AS \"end\" FROM m JOIN c USING (gid) WHERE centre >= a AND centre < b")
def closure(spark, sf):
    """The union of overlapping spans that holds the middle of the strongest one."""
    s = spans(spark, sf)
    centre = s.groupBy("gid").agg(F.max_by((F.col("start") + F.col("end")) / 2, F.struct("v", -F.col("ord"))).alias("t"))
    return I.points_in_spans(centre, I.merged(s), 24.0).select("gid", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("q_confusion_slots")
def confusion_slots(spark, sf):
    """Alternatives of each slot of a conversation's turns with their share of the beams' softmax mass. All words of each turn are aligned to the first turn with words; slots are its words and the boundaries where a turn inserts some, and "" is the turns that have none there."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", X.words(F.col("text")).alias("ws"))
    own = c.groupBy("conv_id").agg(F.min("turn").alias("first"), F.min(F.when(F.size("ws") > 0, F.struct("turn", "ws")))["ws"].alias("anchor"))
    beams = c.join(own, "conv_id").withColumn("m", F.exp((F.col("first") - F.col("turn")) / 2))
    total = beams.groupBy("conv_id").agg(F.sum("m").alias("mass"), F.count("*").alias("beams"))
    w = beams.where("anchor is not null").select("conv_id", "m", F.explode(X.aligned_slots(F.col("anchor"), F.col("ws"))).alias("x")).select("conv_id", "m", "x.*")
    said = w.groupBy("conv_id", "kind", "slot", "word").agg(F.sum("m").alias("m"), F.count("*").alias("n"))
    rest = said.groupBy("conv_id", "kind", "slot").agg(F.sum("m").alias("m"), F.sum("n").alias("n")).join(total, "conv_id").where("n < beams")
    share = said.join(total, "conv_id").select("conv_id", "kind", "slot", "word", (F.col("m") / F.col("mass")).alias("p"))
    none = rest.select("conv_id", "kind", "slot", F.lit("").alias("word"), F.greatest(1 - F.col("m") / F.col("mass"), F.lit(0.0)).alias("p"))
    return share.unionByName(none).withColumn("p", F.round("p", 6))


@query("q_block_coverage", f"WITH {SPANS_SQL}, g AS (SELECT gid, f AS frame, (f * 4.0)::DOUBLE AS t FROM (SELECT DISTINCT gid FROM spans), (SELECT unnest({cells_sql(FRAME_HOURS)}) AS f)), h AS (SELECT g.gid, frame // 25 AS block, max(CASE WHEN s.ord IS NULL THEN 0 ELSE 1 END) AS y FROM g LEFT JOIN spans s ON s.gid = g.gid AND t >= s.start AND t < s.\"end\" GROUP BY g.gid, frame) SELECT gid, block, sum(y)::BIGINT AS covered FROM h GROUP BY ALL")
def block_coverage(spark, sf):
    """Frames of each block that the union of a group's spans covers."""
    s = spans(spark, sf)
    g = grid(spark, sf).join(s.select("gid").distinct(), "gid", "left_semi")
    hit = I.points_in_spans(g, s, 24.0, how="left_semi").select("gid", "frame", F.lit(1).alias("y"))
    return g.join(hit, ["gid", "frame"], "left").groupBy("gid", F.floor(F.col("frame") / 25).alias("block")).agg(F.sum(F.coalesce("y", F.lit(0))).alias("covered"))

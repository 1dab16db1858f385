"""Queries on filled times, label predicates, discovery, event scores and coalitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.functions import scalars as S
from chronoloom.operators.asof import asof
from chronoloom.plans.catalog import query
from chronoloom.plans.frames import CURVE_SQL, FRAME_HOURS, GRID_SQL, SPANS_SQL, curve, grid, read, spans


@query(
    "q_fill_ends",
    """WITH s AS (SELECT conv_id, turn, text, turn * 10.0::DOUBLE AS start, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 5 = 1 THEN turn * 10.0::DOUBLE ELSE turn * 10.0::DOUBLE + 10 END AS e,
      CASE WHEN conv_id % 2 = 0 THEN (max(turn) OVER (PARTITION BY conv_id) + 1) * 10.0::DOUBLE END AS duration, lead(turn * 10.0::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations),
    f AS (SELECT *, coalesce(e, following, duration, start + 30) AS a FROM s)
    SELECT conv_id, turn, CASE WHEN a > start THEN a END AS next_end, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND e IS NOT NULL THEN CASE WHEN e <= start THEN start + 1 ELSE e END END AS second_end FROM f""",
)
def fill_ends(spark, sf):
    """Ends of segments by two policies, null if the segment is dropped: a missing one is the next start, the duration or 30 seconds on; or segments without text or end are dropped and empty ones last a second."""
    o = W.partitionBy("conv_id").orderBy("turn")
    turn = F.col("turn")
    start = turn * 10.0
    end = F.when(turn % 3 == 0, F.lit(None)).when(turn % 5 == 1, start).otherwise(start + 10)
    duration = F.when(F.col("conv_id") % 2 == 0, (F.max("turn").over(W.partitionBy("conv_id")) + 1) * 10.0)
    s = read(spark, sf, "conversations").select("conv_id", "turn", "text", start.alias("start"), end.alias("end"), F.lead(start).over(o).alias("following"), duration.alias("duration"))
    known = F.regexp_replace("text", r"[ \t\n\r]+", "") != ""
    return s.select("conv_id", "turn", S.filled_end(F.col("start"), F.col("end"), F.col("following"), F.col("duration")).alias("next_end"), F.when(known, S.widened_end(F.col("start"), F.col("end"))).alias("second_end"))


_BITS = ", ".join(f"(event_id % {2 ** (k + 1)} >= {2**k})::INT" for k in range(6))


@query("q_label_dims", f"WITH l AS (SELECT event_id, [{_BITS}] AS l FROM events) SELECT event_id, list_max(l[2:]) = 1 AS offensive, l[2] = 1 AS strict, l[1] = 1 AND list_max(l[2:]) = 0 AS normal FROM l")
def label_dims(spark, sf):
    """Predicates on a label of six dimensions: any but the first, the second alone, the first and no other."""
    label = F.array(*[(F.col("event_id") % 2 ** (k + 1) >= 2**k).cast("int") for k in range(6)])
    e = read(spark, sf, "events").select("event_id", label.alias("l"))
    return e.select("event_id", S.any_dim(F.col("l"), 1, 5).alias("offensive"), S.any_dim(F.col("l"), 1, 1).alias("strict"), S.only_first(F.col("l")).alias("normal"))


#: The verdict asked for, and names that stand for no mechanism.
VERDICT, UNNAMED = "HATEFUL_OR_OFFENSIVE", ("none", "unknown", "")


def uncovered(observations: DataFrame, covered: list[str]) -> DataFrame:
    """Observations (verdict, rules, mechanism) of the verdict, without a covering rule, whose mechanism is named and not covered: with ``base``, the mechanism, or what stands before a colon if it begins with "other"."""
    name = F.trim(F.lower(F.coalesce("mechanism", F.lit("none"))))
    base = F.when(name.startswith("other"), F.substring_index(name, ":", 1)).otherwise(name)
    none = F.coalesce(F.size("rules"), F.lit(0)) <= 0  # a null list has size -1 or null
    return observations.withColumn("base", base).where((F.col("verdict") == VERDICT) & none & ~name.isin(*UNNAMED) & ~F.col("base").isin(*covered))


@query(
    "q_discovery",
    """WITH o AS (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN 'HATEFUL_OR_OFFENSIVE' ELSE 'NORMAL' END AS verdict, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN [source] ELSE [] END AS rules,
      CASE doc_id % 5 WHEN 0 THEN 'OTHER: ' || lang WHEN 1 THEN ' None ' WHEN 2 THEN NULL ELSE upper(lang) END AS mechanism FROM documents),
    n AS (SELECT *, trim(lower(coalesce(mechanism, 'none'))) AS name FROM o), b AS (SELECT *, CASE WHEN name LIKE 'other%' THEN string_split(name, ':')[1] ELSE name END AS base FROM n)
    SELECT doc_id, base FROM b WHERE verdict = 'HATEFUL_OR_OFFENSIVE' AND coalesce(len(rules), 0) = 0 AND name NOT IN ('none', 'unknown', '') AND base NOT IN ('fr', 'de')""",
)
def discovery(spark, sf):
    i = F.col("doc_id")
    rules = F.when(i % 7 == 0, F.lit(None)).when(i % 3 == 0, F.array("source")).otherwise(F.array().cast("array<string>"))
    mechanism = F.when(i % 5 == 0, F.concat(F.lit("OTHER: "), "lang")).when(i % 5 == 1, " None ").when(i % 5 == 2, F.lit(None)).otherwise(F.upper("lang"))
    o = read(spark, sf, "documents").select("doc_id", F.when(i % 4 > 0, VERDICT).otherwise("NORMAL").alias("verdict"), rules.alias("rules"), mechanism.alias("mechanism"))
    return uncovered(o, ["fr", "de"]).select("doc_id", "base")


@query(
    "q_event_scores",
    f"""WITH {SPANS_SQL}, {GRID_SQL}, v AS (SELECT gid, ord, start, CASE WHEN ord % 4 <> 1 THEN v / 100 END AS v FROM spans), j AS (SELECT g.gid, g.frame, s.ord, s.v FROM grid g ASOF LEFT JOIN v s ON g.gid = s.gid AND g.t + 2 >= s.start)
    SELECT j.gid, j.frame, round(coalesce(CASE WHEN j.ord IS NULL THEN f.v ELSE j.v END, 0.5), 6) AS score, CASE WHEN j.ord IS NULL THEN f.v ELSE j.v END IS NULL AS filled FROM j LEFT JOIN v f ON f.gid = j.gid AND f.ord = 0""",
)
def event_scores(spark, sf):
    """Score of the event at each frame's middle, the first one's before it begins; events that were not parsed, and groups without any, get one half and are marked."""
    s = spans(spark, sf).select("gid", "ord", F.col("start").alias("t"), F.when(F.col("ord") % 4 != 1, F.col("v") / 100).alias("v"))
    frames = grid(spark, sf).select("gid", "frame", (F.col("t") + FRAME_HOURS / 2).alias("t"))
    first = s.where("ord = 0").select("gid", F.col("v").alias("first"))
    found = asof(frames, s.select("gid", "t", "v"), 48.0).join(first, "gid", "left")
    score = F.when(F.col("found").isNull(), F.col("first")).otherwise(F.col("found.v"))
    return found.select("gid", "frame", F.round(F.coalesce(score, F.lit(0.5)), 6).alias("score"), score.isNull().alias("filled"))


@query(
    "q_coalition_worth",
    f"""WITH {CURVE_SQL}, v AS (SELECT gid, floor(t / 48)::BIGINT AS w, coalesce(avg(s) FILTER (event_type = 'view'), 0) / 20 AS a, coalesce(avg(s) FILTER (event_type = 'click'), 0) / 20 AS b, coalesce(avg(s) FILTER (event_type = 'error'), 0) / 20 AS c FROM curve GROUP BY ALL)
    SELECT gid, w, round(a, 6) AS a, round(ln((exp(a) + exp(b)) / 2), 6) AS ab, round(ln((exp(b) + exp(c)) / 2), 6) AS bc, round(ln((exp(a) + exp(b) + exp(c)) / 3), 6) AS abc FROM v""",
)
def coalition_worth(spark, sf):
    """Worth of coalitions of three streams in each window: the log of the mean of their members' exponentials, a single member's own value."""
    mean = lambda k: F.coalesce(F.avg(F.when(F.col("event_type") == k, F.col("s"))), F.lit(0.0)) / 20
    v = curve(spark, sf).groupBy("gid", F.floor(F.col("t") / 48).alias("w")).agg(mean("view").alias("a"), mean("click").alias("b"), mean("error").alias("c"))
    worth = lambda p: (S.log_sum_exp(F.array(*p)) - F.log(F.lit(float(len(p))))).alias(p)
    return v.select("gid", "w", "a", worth("ab"), worth("bc"), worth("abc")).select("gid", "w", *[F.round(c, 6).alias(c) for c in ("a", "ab", "bc", "abc")])


@query(
    "q_ordinal_terms",
    f"""WITH {CURVE_SQL}, m AS (SELECT gid, k, coalesce((avg(s) FILTER (idx % 10 = k) - 50) / 20, 0) AS m FROM curve, range(10) r(k) GROUP BY gid, k), p AS (SELECT *, 1 / (1 + exp(-m)) AS p FROM m), c AS (SELECT *, sum(p) OVER (PARTITION BY gid ORDER BY k) AS c FROM p),
    x AS (SELECT i.gid, k.k, i.k AS i, max((j.c - i.c + i.p) / (j.k - i.k + 1)) AS hi FROM c i JOIN c k ON k.gid = i.gid AND k.k >= i.k JOIN c j ON j.gid = i.gid AND j.k >= k.k GROUP BY ALL), q AS (SELECT gid, k, min(hi) AS q FROM x GROUP BY gid, k),
    z AS (SELECT gid, avg(q) AS s, max(q) AS first, min(q) AS last, avg(p) AS r, avg(m) AS z_mean FROM q JOIN p USING (gid, k) GROUP BY gid)
    SELECT gid, round(ln(s) - ln(1 - s), 6) AS z_ord, round(ln(r) - ln(1 - r), 6) AS z_raw, round(z_mean, 9) AS z_mean, round(first, 6) AS first, round(last, 6) AS last FROM z""",
)
def ordinal_terms(spark, sf):
    """Logits of the mean of ten graded chances after and before they are made non-increasing, the mean of their margins, and the ends of the projection."""
    c = curve(spark, sf)
    margins = F.array(*[F.coalesce((F.avg(F.when(F.col("idx") % 10 == k, F.col("s"))) - 50) / 20, F.lit(0.0)) for k in range(10)])
    g = c.groupBy("gid").agg(margins.alias("m")).withColumn("p", F.transform("m", S.sigmoid)).withColumn("q", S.nonincreasing(F.col("p")))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
    return g.select("gid", F.round(S.logit(mean("q"), 1e-4), 6).alias("z_ord"), F.round(S.logit(mean("p"), 1e-4), 6).alias("z_raw"), F.round(mean("m"), 9).alias("z_mean"), F.round(F.element_at("q", 1), 6).alias("first"), F.round(F.element_at("q", -1), 6).alias("last"))


@query(
    "q_max_sum_stretch",
    f"""WITH {CURVE_SQL}, r AS (SELECT gid, idx, sum(s - 50) OVER (PARTITION BY gid ORDER BY idx ROWS UNBOUNDED PRECEDING) AS p FROM curve), p AS (FROM r UNION ALL SELECT DISTINCT gid, -1, 0 FROM r),
    x AS (SELECT b.gid, a.idx + 1 AS start, b.idx AS "end", round(b.p - a.p, 6) AS v FROM p a JOIN p b ON a.gid = b.gid AND a.idx < b.idx), m AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY v DESC, start, "end") AS k FROM x WHERE v > 0)
    SELECT gid, start, "end", v AS best FROM m WHERE k = 1""",
)
def max_sum_stretch(spark, sf):
    """The stretch with the largest positive sum, the earliest of equals; series without one are left out."""
    own, before = W.partitionBy("gid"), (W.unboundedPreceding, -1)
    gain = lambda end, start: F.round(end - start, 6)
    p = curve(spark, sf).withColumn("p", F.sum(F.col("s") - 50).over(own.orderBy("idx").rowsBetween(W.unboundedPreceding, 0)))
    # equal stretches are equal after rounding, so the best gain is found first, then the first start that reaches it, then that start's first end
    low = F.least(F.lit(0.0), F.min("p").over(own.orderBy("idx").rowsBetween(*before)))
    high = F.max("p").over(own.orderBy(F.desc("idx")).rowsBetween(*before))
    x = p.withColumns({"low": low, "high": high, "top": F.max("p").over(own)}).withColumn("best", F.max(gain(F.col("p"), F.col("low"))).over(own)).where("best > 0")
    first = lambda start, total: F.struct(start.cast("int").alias("start"), total.alias("p"))
    whole = F.when(gain(F.col("top"), F.lit(0.0)) == F.col("best"), first(F.lit(0), F.lit(0.0)))
    later = F.min(F.when(gain(F.col("high"), F.col("p")) == F.col("best"), first(F.col("idx") + 1, F.col("p")))).over(own)
    f = x.withColumn("f", F.coalesce(whole, later))
    return f.where((F.col("idx") >= F.col("f.start")) & (gain(F.col("p"), F.col("f.p")) == F.col("best"))).groupBy("gid", F.col("f.start").alias("start"), "best").agg(F.min("idx").alias("end")).select("gid", "start", "end", "best")

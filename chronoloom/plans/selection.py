"""Queries on top-k, deduplication, splits and budgets."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.operators import ranks
from chronoloom.plans.catalog import query
from chronoloom.plans.frames import CURVE_SQL, curve, points, read


@query("q_dedup_first", "SELECT DISTINCT ON (l_partkey) l_partkey, l_orderkey, l_linenumber FROM lineitem ORDER BY l_partkey, l_orderkey, l_linenumber")
def dedup_first(spark, sf):
    """First row of a key: an aggregate and not a window, so it combines before the shuffle."""
    first = F.min(F.struct("l_orderkey", "l_linenumber")).alias("f")
    return read(spark, sf, "lineitem").groupBy("l_partkey").agg(first).select("l_partkey", "f.l_orderkey", "f.l_linenumber")


@query("q_latest_record", f"WITH {CURVE_SQL} SELECT gid, event_type, max(event_id) AS event_id, arg_max(s, event_id) AS s FROM curve GROUP BY ALL")
def latest_record(spark, sf):
    """The last record of a key wins."""
    return curve(spark, sf).groupBy("gid", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("s", "event_id").alias("s"))


@query("q_dedup_index", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedup_index(spark, sf):
    """Smallest index of each distinct text, grouped by a 256-bit digest and length."""
    d = read(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"), F.length("text").alias("n_chars"))
    return d.groupBy("h", "n_chars").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


@query("q_dedup_max_edges", "SELECT o_custkey AS a, l_suppkey AS b, max(l_extendedprice) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def dedup_max_edges(spark, sf):
    l, o = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.max("l_extendedprice").alias("w"))


@query("q_topk_deterministic", "WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE r <= 3")
def topk_deterministic(spark, sf):
    r = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", r.alias("r")).where("r <= 3").drop("r")


@query("q_topk_ratio", f"WITH {CURVE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY s DESC, idx) AS r, count(*) OVER (PARTITION BY gid) AS n FROM curve) SELECT event_id FROM r WHERE r <= greatest(1, floor(0.15 * n))")
def topk_ratio(spark, sf):
    """A share of each group, at least one."""
    r = F.row_number().over(W.partitionBy("gid").orderBy(F.desc("s"), "idx"))
    n = F.count("*").over(W.partitionBy("gid"))
    return curve(spark, sf).select("event_id", r.alias("r"), n.alias("n")).where(F.col("r") <= F.greatest(F.lit(1), F.floor(0.15 * F.col("n")))).select("event_id")


@query("q_time_order", f"WITH {CURVE_SQL}, d AS (SELECT gid, event_id, abs(t - 360) AS d FROM curve WHERE abs(t - 360) >= 24), r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY d, event_id) AS r FROM d) SELECT gid, event_id, r FROM r WHERE r <= 5")
def time_order(spark, sf):
    """Nearest in time to a moment, its own day left out."""
    d = curve(spark, sf).select("gid", "event_id", F.abs(F.col("t") - 360).alias("d")).where("d >= 24")
    return d.select("gid", "event_id", F.row_number().over(W.partitionBy("gid").orderBy("d", "event_id")).alias("r")).where("r <= 5")


@query("q_matched_budget", f"WITH {CURVE_SQL}, k AS (SELECT event_type, floor(t / 240) AS len, count(*) AS k FROM curve WHERE y = 1 OR s > 90 GROUP BY ALL), r AS (SELECT event_id, floor(t / 240) AS len, event_type, row_number() OVER (PARTITION BY event_type, floor(t / 240) ORDER BY s, event_id) AS r FROM curve) SELECT event_id FROM r JOIN k USING (event_type, len) WHERE r <= k")
def matched_budget(spark, sf):
    """As many of each length bucket, in order of preference, as another selection has."""
    c = points(spark, sf).withColumn("len", F.floor(F.col("t") / 240))
    k = c.where("y = 1 or s > 90").groupBy("event_type", "len").agg(F.count("*").alias("k"))
    r = ranks.group_rank(c.select("event_id", "event_type", "len", "s"), ["event_type", "len"], ["s", "event_id"], "r")
    return r.join(k, ["event_type", "len"]).where("r < k").select("event_id")


@query(
    "q_bucket_rotation",
    f"""WITH {CURVE_SQL}, r AS (SELECT gid, event_id, event_type, floor(t / 72) AS w, row_number() OVER (PARTITION BY gid, event_type ORDER BY floor(t / 72), event_id) - 1 AS r, count(*) OVER (PARTITION BY gid, event_type) AS n, count(*) OVER (PARTITION BY gid, event_type, floor(t / 72)) AS own FROM curve),
    l AS (SELECT *, max(own) OVER (PARTITION BY gid, event_type) AS largest FROM r) SELECT a.event_id, b.event_id AS source FROM l a JOIN l b ON a.gid = b.gid AND a.event_type = b.event_type AND b.r = (a.r + a.largest) % a.n""",
)
def bucket_rotation(spark, sf):
    """Each row takes its source as far ahead in its bucket, ordered by window, as the bucket's largest window has rows: as many sources as can be are from other windows."""
    g = W.partitionBy("gid", "event_type")
    c = curve(spark, sf).select("gid", "event_id", "event_type", F.floor(F.col("t") / 72).alias("w"))
    r = c.select("*", (F.row_number().over(g.orderBy("w", "event_id")) - 1).alias("r"), F.count("*").over(g).alias("n"), F.count("*").over(W.partitionBy("gid", "event_type", "w")).alias("own"))
    a = r.withColumn("to", (F.col("r") + F.max("own").over(g)) % F.col("n"))
    b = r.select("gid", "event_type", F.col("event_id").alias("source"), F.col("r").alias("to"))
    return a.join(b, ["gid", "event_type", "to"]).select("event_id", "source")


@query("q_derangement", "WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT a.c_custkey, b.c_custkey AS other FROM r a JOIN r b ON a.c_nationkey = b.c_nationkey AND b.r = a.r % a.n + 1")
def derangement(spark, sf):
    """A roll by one inside groups: no row meets itself in groups of two or more."""
    g = W.partitionBy("c_nationkey")
    o = g.orderBy("c_custkey")
    c = read(spark, sf, "customer")
    return c.select("c_custkey", F.coalesce(F.lead("c_custkey").over(o), F.first("c_custkey").over(o)).alias("other"))


def _hash_order(key: str):
    return F.md5(F.concat(F.lit("7:"), F.col(key).cast("string")))


@query("q_stratified_split", "WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5('7:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY quality, toxic) AS n FROM labels) SELECT doc_id, CASE WHEN r <= round_even(0.2 * n, 0) THEN 'test' WHEN r <= round_even(0.3 * n, 0) THEN 'val' ELSE 'train' END AS split FROM r")
def stratified_split(spark, sf):
    """Shares of each stratum in the order of a seeded hash."""
    l = read(spark, sf, "labels").select("doc_id", "quality", "toxic", _hash_order("doc_id").alias("h"))
    r = ranks.group_rank(l, ["quality", "toxic"], ["h", "doc_id"], "r", "n")
    return r.select("doc_id", F.when(F.col("r") < F.rint(0.2 * F.col("n")), "test").when(F.col("r") < F.rint(0.3 * F.col("n")), "val").otherwise("train").alias("split"))


@query("q_validation_carve", "WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5('7:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id FROM r WHERE r <= least(greatest(round_even(0.1 * n, 0), 1), n - 1)")
def validation_carve(spark, sf):
    """A tenth of each class, at least one row and never all."""
    l = read(spark, sf, "labels").select("doc_id", "quality", _hash_order("doc_id").alias("h"))
    r = ranks.group_rank(l, ["quality"], ["h", "doc_id"], "r", "n")
    return r.where(F.col("r") < F.least(F.greatest(F.rint(0.1 * F.col("n")), F.lit(1.0)), F.col("n") - 1)).select("doc_id")


@query(
    "q_uncertain_band",
    f"""WITH {CURVE_SQL}, e AS (SELECT event_id, y, 1 / (1 + exp(-(s - 50) / 20)) AS p FROM curve WHERE s BETWEEN 10 AND 90), h AS (SELECT *, round(-(p * ln(p) + (1 - p) * ln(1 - p)), 9) AS h FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h DESC, event_id) AS r FROM h),
    k AS (SELECT greatest(1, ceil(count(*) * 0.05))::BIGINT AS n, count(*) FILTER (y = 0) AS a, count(*) FILTER (y = 1) AS b FROM e), n AS (SELECT n, a, b, least(b, n - least(a, n // 2)) AS n1 FROM k)
    SELECT event_id, y FROM r, n WHERE r <= CASE WHEN y = 1 THEN n1 ELSE least(a, n - n1) END""",
)
def uncertain_band(spark, sf):
    """A twentieth of a band, half from each label if they have so many, the most uncertain first."""
    from chronoloom.functions import scalars as S

    h = F.round(S.entropy(S.sigmoid((F.col("s") - 50) / 20)), 9)
    band = curve(spark, sf).where("s between 10 and 90").select("event_id", "y", h.alias("h"))
    k = band.agg(F.count("*").alias("n"), F.count_if(F.col("y") == 0).alias("a"), F.count_if(F.col("y") == 1).alias("b")).first()
    n = max(1, math.ceil(k["n"] * 0.05))
    n1 = min(k["b"], n - min(k["a"], n // 2))
    n0 = min(k["a"], n - n1)
    r = ranks.group_rank(band.withColumn("less", -F.col("h")), ["y"], ["less", "event_id"], "r")
    return r.where(F.col("r") < F.when(F.col("y") == 1, n1).otherwise(n0)).select("event_id", "y")


@query("q_ordered_union", f"WITH {CURVE_SQL}, a AS (SELECT gid, list_slice(list(event_id ORDER BY idx), 1, 6) AS a, list_slice(list(event_id ORDER BY s DESC, idx), 1, 6) AS b FROM curve GROUP BY gid) SELECT gid, array_to_string(list_slice(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), 1, 8), ',') AS ids FROM a")
def ordered_union(spark, sf):
    """Two short lists united in order, at most eight entries."""
    rank = lambda *o: F.row_number().over(W.partitionBy("gid").orderBy(*o))
    c = curve(spark, sf).select("gid", "event_id", "idx", "s", rank("idx").alias("r1"), rank(F.desc("s"), "idx").alias("r2")).where("r1 <= 6 or r2 <= 6")
    ids = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col(r) <= 6, F.struct(r, "event_id")))), lambda x: x["event_id"])
    lists = c.groupBy("gid").agg(ids("r1").alias("a"), ids("r2").alias("b"))
    return lists.select("gid", F.array_join(F.slice(F.array_union("a", "b"), 1, 8), ",").alias("ids"))


@query("q_source_priority", "WITH u AS (SELECT doc_id, 1 AS p FROM labels UNION ALL SELECT doc_id, 2 FROM documents UNION ALL SELECT page_id, 3 FROM pages) SELECT doc_id, min(p) AS source FROM u GROUP BY doc_id")
def source_priority(spark, sf):
    """The first of several sources that has a key."""
    parts = [read(spark, sf, t).select(F.col(k).alias("doc_id"), F.lit(p).alias("p")) for t, k, p in (("labels", "doc_id", 1), ("documents", "doc_id", 2), ("pages", "page_id", 3))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("doc_id").agg(F.min("p").alias("source"))


@query("q_prevalence_sample", "WITH c AS (SELECT count(*) FILTER (quality = 0) AS neg FROM labels), k AS (SELECT greatest(1, floor(0.25 * neg / 0.75))::BIGINT AS k FROM c), r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS r FROM labels WHERE quality = 1) SELECT doc_id FROM r, k WHERE r <= k")
def prevalence_sample(spark, sf):
    """As many positives as a prevalence of a quarter needs."""
    l = read(spark, sf, "labels")
    k = max(1, int(0.25 * l.where("quality = 0").count() / 0.75))
    return l.where("quality = 1").orderBy(_hash_order("doc_id"), "doc_id").limit(k).select("doc_id")

"""Queries on token frames: vectors of a label in the order of their ids are cut into frames of twelve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import tokens as K
from chronoloom.operators.ranks import group_rank
from chronoloom.plans.catalog import query
from chronoloom.plans.frames import read
from chronoloom.storage import fresh_path
from chronoloom.streaming import comparison
from chronoloom.streaming.stores import rocks

PER_FRAME, DIMS = 12, 64
HOW = K.Grouping(budget=8, similarity=0.0, neighbours=4)

TOKENS_SQL = f"""tok AS MATERIALIZED (SELECT gid, r // {PER_FRAME} AS frame, r % {PER_FRAME} AS token, count(*) OVER (PARTITION BY gid, r // {PER_FRAME}) AS n, v, v[1] AS salience
  FROM (SELECT label AS gid, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, embedding::DOUBLE[] AS v FROM embeddings)),
marked AS MATERIALIZED (SELECT a.*, coalesce(a.n = b.n AND list_cosine_similarity(a.v, b.v) > {HOW.similarity}, false) AS static FROM tok a LEFT JOIN tok b ON a.gid = b.gid AND a.token = b.token AND a.frame = b.frame + 1),
budgets AS (SELECT gid, frame, n, count(*) FILTER (static) AS s, least({HOW.budget}, n) AS g, (least({HOW.budget}, n) * count(*) FILTER (static)) // n AS ks FROM marked GROUP BY gid, frame, n),
pairs AS MATERIALIZED (SELECT a.gid, a.frame, a.token AS i, b.token AS j, list_distance(a.v, b.v) / sqrt({DIMS}) AS d FROM marked a JOIN marked b USING (gid, frame) WHERE a.static AND b.static),
near AS (SELECT *, row_number() OVER (PARTITION BY gid, frame, i ORDER BY d, j) AS k, count(*) OVER (PARTITION BY gid, frame, i) AS m FROM pairs),
dense AS MATERIALIZED (SELECT gid, frame, i, exp(-avg(d * d)) AS rho FROM near WHERE k <= least({HOW.neighbours}, m - 1) GROUP BY ALL),
most AS (SELECT gid, frame, max(d) AS top FROM pairs GROUP BY ALL),
sep AS (SELECT p.gid, p.frame, p.i, any_value(a.rho) * min(CASE WHEN a.rho > b.rho OR (a.rho = b.rho AND p.i < p.j) THEN p.d ELSE top END) AS score FROM pairs p JOIN dense a ON a.gid = p.gid AND a.frame = p.frame AND a.i = p.i JOIN dense b ON b.gid = p.gid AND b.frame = p.frame AND b.i = p.j JOIN most ON most.gid = p.gid AND most.frame = p.frame GROUP BY p.gid, p.frame, p.i),
ranked AS (SELECT *, row_number() OVER (PARTITION BY gid, frame ORDER BY score DESC, i) AS k FROM sep),
centres AS MATERIALIZED (SELECT gid, frame, i AS root FROM ranked JOIN budgets USING (gid, frame) WHERE s > ks AND k <= ks UNION ALL SELECT gid, frame, token FROM marked JOIN budgets USING (gid, frame) WHERE static AND s = ks),
nearest AS (SELECT p.gid, p.frame, p.i AS member, arg_min(p.j, (CASE WHEN p.i = p.j THEN -1 ELSE p.d END, p.j)) AS root FROM pairs p JOIN centres c ON c.gid = p.gid AND c.frame = p.frame AND c.root = p.j GROUP BY p.gid, p.frame, p.i),
sized AS (SELECT *, count(*) OVER (PARTITION BY gid, frame, root) AS size FROM nearest),
moved AS (SELECT gid, frame, token, g - ks AS kd, row_number() OVER (PARTITION BY gid, frame ORDER BY salience DESC, token) AS k FROM marked JOIN budgets USING (gid, frame) WHERE NOT static),
groups AS MATERIALIZED (SELECT gid, frame, root, 'static' AS kind, member, CASE WHEN size = 1 THEN 1.0 WHEN root = member THEN {HOW.centre_weight} ELSE (1 - {HOW.centre_weight}::DOUBLE) / (size - 1) END::DOUBLE AS weight FROM sized
  UNION ALL SELECT gid, frame, token, 'dynamic', token, 1.0 FROM moved WHERE k <= kd)"""
GROUPS_SQL = f"WITH {TOKENS_SQL} SELECT gid, frame, root, kind, member, round(weight, 9) AS weight FROM groups"


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token rows; ranks in a label are taken in ranges, so that a label of most vectors is no single task."""
    e = read(spark, sf, "embeddings").select(F.col("label").cast("long").alias("gid"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    e = group_rank(e, ["gid"], ["vec_id"], "r", size="of")
    frame = F.floor(F.col("r") / PER_FRAME)
    n = F.least(F.lit(PER_FRAME), F.col("of") - frame * PER_FRAME).cast("int")
    return e.select("gid", frame.alias("frame"), (F.col("r") % PER_FRAME).cast("long").alias("token"), n.alias("n"), "v", F.get("v", F.lit(0)).alias("salience"))


def _rounded(groups: DataFrame) -> DataFrame:
    return groups.select("gid", "frame", "root", "kind", "member", F.round("weight", 9).alias("weight"))


@query("q_token_groups", GROUPS_SQL)
def token_groups(spark, sf):
    """Groups of every frame: density peaks among the tokens that stayed, the most salient of those that moved."""
    return _rounded(K.grouped(K.compared(_tokens(spark, sf), HOW), HOW))


@query("q_token_vectors", f"WITH {TOKENS_SQL} SELECT gid, frame, root, kind, count(*) AS members, round(sum(weight * v[1]), 6) AS first, round(sum(weight * v[{DIMS}]), 6) AS last, round(sum(weight * list_sum(v)), 6) AS total FROM groups g JOIN (SELECT gid, frame, token AS member, v FROM tok) USING (gid, frame, member) GROUP BY ALL")
def token_vectors(spark, sf):
    """The weighted vector of every group."""
    t = _tokens(spark, sf)
    a = K.aggregated(t, K.grouped(K.compared(t, HOW), HOW), DIMS)
    return a.select("gid", "frame", "root", "kind", "members", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(DIMS - 1)), 6).alias("last"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("q_stream_token_groups", GROUPS_SQL)
def stream_token_groups(spark, sf):
    """The same groups from a stream of token rows that arrive in three parts, each a run of the stream that goes on from the checkpoint of the one before."""
    folder = fresh_path(spark, "tokens")
    t = _tokens(spark, sf)
    frames = (t.agg(F.max("frame").alias("f")).first()["f"] or 0) + 1
    with rocks(spark):
        for k in range(3):
            t.where((F.col("frame") >= frames * k // 3) & (F.col("frame") < frames * (k + 1) // 3)).write.mode("append").parquet(f"{folder}/in")
            groups = comparison.drained_groups(spark.readStream.schema(t.schema).parquet(f"{folder}/in"), folder, HOW)
    return _rounded(groups)

"""Streaming queries over the events table read as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.plans.catalog import query
from chronoloom.plans.frames import CURVE_SQL, read
from chronoloom.storage import fresh_path
from chronoloom.streaming import stateful as S
from chronoloom.streaming import trackers as T
from chronoloom.streaming.stores import rocks


def _folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one."""
    return fresh_path(spark, "stream")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events file or folder as a stream; a file is found by its name in its folder."""
    schema = read(spark, sf, "events").schema
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "false")
    return reader.parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _hours():
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP '2024-01-01 00:00:00', ts)") / F.lit(3.6e9)


@query("q_stream_last_record", f"WITH {CURVE_SQL} SELECT gid AS user_id, arg_max(s, event_id) AS value, count(*) AS n FROM curve GROUP BY gid")
def stream_last_record(spark, sf):
    return S.drained(S.last_records(_events(spark, sf), ["user_id"], "event_id", "value"), "last", _folder(spark), "complete")


@query("q_stream_windows", "SELECT time_bucket(INTERVAL 2 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    w = S.drained(S.window_means(_events(spark, sf), "2 days"), "windows", _folder(spark), "complete")
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("q_stream_gap_tracks", f"WITH {CURVE_SQL}, g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY gid, event_type ORDER BY t, event_id) > 48, true)::INT AS new FROM curve), k AS (SELECT *, sum(new) OVER (PARTITION BY gid, event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT gid, event_type AS label, count(*) AS n, round(min(t), 6) AS start, round(max(t), 6) AS \"end\" FROM k GROUP BY gid, event_type, k")
def stream_gap_tracks(spark, sf):
    """Tracks of the stream; with room for all labels they are those of the whole table."""
    e = _events(spark, sf).select(F.col("user_id").alias("gid"), F.col("event_type").alias("label"), _hours().alias("t"))
    t = S.drained(S.tracks(e, 48.0, 99, final=True), "tracks", _folder(spark))
    return t.select("gid", "label", "n", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("q_stream_capacity_tracks")
def stream_capacity_tracks(spark, sf):
    """At most three live tracks of a user; the oldest gives way."""
    e = _events(spark, sf).select(F.col("user_id").alias("gid"), F.col("event_type").alias("label"), _hours().alias("t"))
    return S.drained(S.tracks(e, 48.0, 3, final=True), "capacity", _folder(spark)).groupBy("gid", "reason").agg(F.count("*").alias("tracks"), F.sum("n").alias("n"))


_ZERO_MS = 1_704_067_200_000  # 2024-01-01


@query(
    "q_stream_silent_tracks",
    f"""WITH {CURVE_SQL}, g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY gid, event_type ORDER BY t, event_id) > 24, true)::INT AS new FROM curve), k AS (SELECT *, sum(new) OVER (PARTITION BY gid, event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
    x AS (SELECT gid, event_type AS label, count(*) AS n, min(t) AS start, max(t) AS "end" FROM k GROUP BY gid, event_type, k), l AS (SELECT gid, max(t) AS last FROM curve GROUP BY gid)
    SELECT gid, label, n, round(start, 6) AS start, round("end", 6) AS "end" FROM x JOIN l USING (gid) WHERE greatest(last, (SELECT max(t) FROM curve) - 1) - "end" > 24""",
)
def stream_silent_tracks(spark, sf):
    """Tracks that a later row of their user or the watermark has ended; what may still go on is not among them."""
    e = _events(spark, sf).select(F.col("user_id").alias("gid"), F.col("event_type").alias("label"), _hours().alias("t"), "ts")
    t = S.drained(S.tracks(e, 24.0, 99, delay="1 hour", zero_ms=_ZERO_MS), "silent", _folder(spark))
    return t.select("gid", "label", "n", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def _ticked(spark: SparkSession, sf: str, folder: str, hours: float) -> DataFrame:
    """The stream of (gid, label, t, ts), then a tick of every user so many hours after the last row, which lets all tracks end."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("gid"), F.col("ts").cast("timestamp").alias("ts"))
    last = e.agg(F.max("ts").alias("last"))
    tick = e.select("gid").distinct().join(F.broadcast(last)).select("gid", (F.col("last") + F.make_interval(hours=F.lit(int(hours)))).alias("ts"))
    tick.write.parquet(f"{folder}/ticks")
    ticks = spark.readStream.schema(tick.schema).parquet(f"{folder}/ticks").select("gid", F.lit(None).cast("string").alias("label"), _hours().alias("t"), "ts")
    return _events(spark, sf).select(F.col("user_id").alias("gid"), F.col("event_type").alias("label"), _hours().alias("t"), "ts").unionByName(ticks)


@query(
    "q_stream_track_ends",
    f"""WITH {CURVE_SQL}, g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY gid, event_type ORDER BY t, event_id) > 48, true)::INT AS new FROM curve), k AS (SELECT *, sum(new) OVER (PARTITION BY gid, event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
    x AS (SELECT gid, event_type AS label, count(*) AS n, min(t) AS start, max(t) AS "end" FROM k GROUP BY gid, event_type, k)
    SELECT gid, row_number() OVER (PARTITION BY gid ORDER BY start, label) - 1 AS track, label, n, round(start, 6) AS start, round("end", 6) AS "end", 'gap' AS reason FROM x""",
)
def stream_track_ends(spark, sf):
    """Ends of tracks in event time, with room for all labels."""
    folder = _folder(spark)
    with rocks(spark):
        r = S.drained(T.records(_ticked(spark, sf, folder, 400), 48.0, 99, 24.0, "1 hour", _ZERO_MS), "records", folder)
    return r.where("kind = 'end'").select("gid", "track", "label", "n", F.round("start", 6).alias("start"), F.round("t", 6).alias("end"), "reason")


@query("q_stream_track_records")
def stream_track_records(spark, sf):
    """Supports and ends of tracks with room for three labels of a user."""
    folder = _folder(spark)
    with rocks(spark):
        r = S.drained(T.records(_ticked(spark, sf, folder, 400), 48.0, 3, 24.0, "1 hour", _ZERO_MS), "records", folder)
    return r.withColumns({c: F.round(c, 6) for c in ("t", "start")})


@query(
    "q_stream_window_picks",
    """WITH e AS (SELECT user_id AS gid, ts, event_id, time_bucket(INTERVAL 3 DAY, ts, TIMESTAMP '1970-01-01') AS start FROM events), w AS (SELECT gid, start, arg_min(event_id, (ts, event_id)) FILTER (ts >= start + INTERVAL 1 DAY) AS a, arg_min(event_id, (ts, event_id)) FILTER (ts >= start + INTERVAL 2 DAY) AS b, arg_max(event_id, (ts, event_id)) AS z FROM e GROUP BY ALL)
    SELECT DISTINCT gid, start, unnest([coalesce(a, z), coalesce(b, z)]) AS event_id FROM w""",
)
def stream_window_picks(spark, sf):
    """Events at one and two thirds of every three days of a user's stream."""
    e = _events(spark, sf).select(F.col("user_id").alias("gid"), "ts", "event_id")
    p = S.drained(S.window_picks(e, "3 days", 3 * 86_400), "picks", _folder(spark), "complete")
    return p.select("gid", F.col("w.start").cast("timestamp_ntz").alias("start"), F.explode("picks").alias("event_id"))


@query("q_stream_changes", f"WITH RECURSIVE {CURVE_SQL}, o AS (SELECT gid, t, s, row_number() OVER (PARTITION BY gid ORDER BY t, s) AS r FROM curve), k AS (SELECT gid, r, t, s, s AS last, true AS kept FROM o WHERE r = 1 UNION ALL SELECT o.gid, o.r, o.t, o.s, CASE WHEN abs(o.s - k.last) >= 10 THEN o.s ELSE k.last END, abs(o.s - k.last) >= 10 FROM k JOIN o ON o.gid = k.gid AND o.r = k.r + 1) SELECT gid, t, s FROM k WHERE kept")
def stream_changes(spark, sf):
    """Rows that moved by ten from the row kept before."""
    e = _events(spark, sf).select(F.col("user_id").alias("gid"), _hours().alias("t"), F.col("value").alias("s"))
    return S.drained(S.changes(e, 10.0), "changes", _folder(spark))


@query("q_stream_first_arrival", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_first_arrival(spark, sf):
    first = S.first_arrivals(_events(spark, sf), ["user_id", "event_type"], delay="3650 days")
    return S.drained(first.select("user_id", "event_type"), "first", _folder(spark)).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("q_stream_daily_arrival", "SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events")
def stream_daily_arrival(spark, sf):
    """The first event of each type that a user has in a day; a key is forgotten once the watermark is a day past it."""
    e = _events(spark, sf).withColumn("day", F.to_date("ts"))
    return S.drained(S.first_arrivals(e, ["user_id", "event_type", "day"], delay="1 day").select("user_id", "event_type", "day"), "daily", _folder(spark))

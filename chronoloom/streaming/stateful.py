"""Stateful operators on streams: tracks that time out, changes against the row before, first arrival, last record.

State is kept per key by Structured Streaming, so it is restored from the
checkpoint when an executor is lost. A key's state has a bounded number of
tracks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRACK = "gid bigint, label string, start double, end double, n bigint, reason string"
STATE = "labels array<string>, starts array<double>, ends array<double>, counts array<bigint>"


def tracks(events: DataFrame, gap: float, capacity: int, final: bool = False, delay: str | None = None, zero_ms: int = 0) -> DataFrame:
    """Rows (gid, label, t), t in hours, to ended tracks.

    A label's track goes on while its observations are no more than ``gap`` apart.
    When more than ``capacity`` tracks of a key are live, the one that began first
    is evicted. Rows of a batch are taken in order of (t, label). With ``final`` the
    tracks still live at the end of a batch are ended too, for a stream that is
    known to be complete. With ``delay`` rows have their time ``ts`` too, which is
    ``zero_ms`` milliseconds since the epoch at t = 0: a watermark of that delay ends
    the tracks of a key that falls silent.
    """
    hour = 3_600_000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        labels, starts, ends, counts = state.get if state.exists else ([], [], [], [])
        live = {k: [a, b, n] for k, a, b, n in zip(labels, starts, ends, counts, strict=True)}
        out = []

        def end(label: str, why: str) -> None:
            a, b, n = live.pop(label)
            out.append((key[0], label, a, b, n, why))

        silent = state.hasTimedOut
        if silent:
            now = (state.getCurrentWatermarkMs() - zero_ms) / hour
            for label in sorted(k for k, v in live.items() if now - v[1] > gap):
                end(label, "gap")
        rows = pd.DataFrame({"label": [], "t": []}) if silent else pd.concat(list(parts)).sort_values(["t", "label"])
        for label, t in zip(rows["label"], rows["t"], strict=True):
            for other in sorted(k for k, v in live.items() if t - v[1] > gap):
                end(other, "gap")
            if label in live:
                live[label][1:] = [float(t), live[label][2] + 1]
            else:
                live[label] = [float(t), float(t), 1]
                if len(live) > capacity:
                    end(min(live, key=lambda k: (live[k][0], k)), "capacity")
        if final:
            for label in sorted(live):
                end(label, "end")
        if delay and not live:
            state.remove()
        else:
            state.update((list(live), [v[0] for v in live.values()], [v[1] for v in live.values()], [v[2] for v in live.values()]))
            if delay:
                first = int(zero_ms + (min(v[1] for v in live.values()) + gap) * hour) + 1
                state.setTimeoutTimestamp(max(first, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["gid", "label", "start", "end", "n", "reason"])

    timeout = GroupStateTimeout.EventTimeTimeout if delay else GroupStateTimeout.NoTimeout
    source = events.withWatermark("ts", delay) if delay else events
    return source.groupBy("gid").applyInPandasWithState(step, TRACK, STATE, "append", timeout)


def changes(events: DataFrame, least: float) -> DataFrame:
    """Rows (gid, t, s) that differ by at least ``least`` from the row kept before: gid, t, s."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["t", "s"])
        kept = []
        for t, s in zip(rows["t"], rows["s"], strict=True):
            if last is None or abs(s - last) >= least:
                kept.append((key[0], float(t), float(s)))
                last = float(s)
        state.update((last,))
        yield pd.DataFrame(kept, columns=["gid", "t", "s"])

    return events.groupBy("gid").applyInPandasWithState(step, "gid bigint, t double, s double", "last double", "append", GroupStateTimeout.NoTimeout)


def first_arrivals(events: DataFrame, keys: list[str], watermark: str = "ts", delay: str = "30 days") -> DataFrame:
    """The first arrival of each key within the watermark."""
    return events.withWatermark(watermark, delay).dropDuplicatesWithinWatermark(keys)


def last_records(events: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The last value of each key so far (update or complete mode)."""
    return events.groupBy(*by).agg(F.max_by(value, order).alias(value), F.count("*").alias("n"))


def window_means(events: DataFrame, length: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Means of event-time windows per type."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def window_picks(events: DataFrame, length: str, seconds: int, delay: str = "1 day") -> DataFrame:
    """(gid, w, picks): of each event-time window the keys of the first rows at or after one and two thirds of it, or its last row where there is none. A window's state is three rows, however many it holds."""
    row = F.struct("ts", "event_id")
    at = events.withWatermark("ts", delay).withColumn("w", F.window("ts", length))
    since = lambda k: F.min(F.when(F.col("ts") >= F.col("w.start") + F.make_interval(secs=F.lit(seconds * k // 3)), row))
    found = at.groupBy("gid", "w").agg(since(1).alias("a"), since(2).alias("b"), F.max(row).alias("z"))
    return found.select("gid", "w", F.array_distinct(F.array(F.coalesce("a.event_id", "z.event_id"), F.coalesce("b.event_id", "z.event_id"))).alias("picks"))


def drained(stream: DataFrame, name: str, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a Parquet table (append) or the last batch's rows (complete), and read it."""
    spark = stream.sparkSession
    out, marks = f"{path}/{name}-out", f"{path}/{name}-checkpoint"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)

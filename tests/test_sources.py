"""File sources and sinks, and streams over them."""

import datetime
import json
import time
import wave

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chronoloom.sources import files
from chronoloom.streaming import stateful


def test_line_records_last_wins(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"video_id": v, "error": e}) + "\n" for v, e in (("x", None), ("y", "bad"), ("x", "late"), ("y", None))))
    raw = files.numbered(spark, str(tmp_path / "a.jsonl"))
    records = raw.select("file", "block", "ordinal", F.from_json("value", "video_id string, error string").alias("r")).select("file", "block", "ordinal", "r.*")
    assert {tuple(r) for r in files.last_wins(records, ["video_id"]).collect()} == {("x", "late"), ("y", None)}
    cohort = spark.createDataFrame([("x",), ("y",), ("z",)], "video_id string")
    assert {r[0] for r in files.pending(cohort, records).collect()} == {"x", "z"}


def test_keys_that_must_be_unique_or_agree(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "k string, v int")
    assert {tuple(r) for r in files.merged_if_equal(df, "k", "v").collect()} == {("a", 1), ("b", 2)}
    with pytest.raises(PySparkException):
        files.unique(df, ["k"]).collect()
    with pytest.raises(PySparkException):
        files.merged_if_equal(df.union(spark.createDataFrame([("a", 3)], "k string, v int")), "k", "v").collect()
    assert files.unique(df.where("k = 'a'"), ["k"]).collect()[0]["v"] == 1


def test_delimited_ids_and_documents(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("﻿id\tlabel\n1\tx\n2\t\"a\nb\"\n", encoding="utf-8")
    assert [tuple(r) for r in files.delimited(spark, str(tmp_path / "t.tsv"), "id int, label string", "\t").orderBy("id").collect()] == [(1, "x"), (2, "a\nb")]
    (tmp_path / "ids.txt").write_text("﻿one\n\n two \n", encoding="utf-8")
    assert {r["id"] for r in files.id_list(spark, str(tmp_path / "ids.txt")).collect()} == {"one", "two"}
    (tmp_path / "d.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert files.document(spark, str(tmp_path / "d.json"), "a int").count() == 2
    (tmp_path / "m.jsonl").write_text(json.dumps({"dataset": "d", "video_id": "v", "duration": 1.5}) + "\n" + json.dumps({"dataset": "e"}) + "\n")
    assert files.manifest(spark, str(tmp_path / "m.jsonl"), ["d"]).collect()[0]["duration"] == 1.5


def test_binary_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for t in ("0.5", "12"):
        (tmp_path / "f" / f"frame_{t}.jpg").write_bytes(b"x")
    (tmp_path / "f" / "other.jpg").write_bytes(b"abc")
    assert sorted(r["t"] for r in files.frame_files(spark, str(tmp_path / "f")).collect()) == [0.5, 12.0]
    assert {r["length"] for r in files.fingerprints(spark, str(tmp_path / "f")).collect()} == {1, 3}
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0\0" * 12_000)
    assert files.wav_durations(spark, str(tmp_path / "a.wav")).collect()[0]["seconds"] == 1.5


def test_evenly_spaced_files_of_each_folder(spark, tmp_path):
    sizes = {"a": 20, "b": 3, "c": 4, "d": 7}
    for folder, n in sizes.items():
        (tmp_path / folder).mkdir()
        for k in range(n):
            (tmp_path / folder / f"frame_{k:03d}.5.jpg").write_bytes(b"x")
    found = files.frame_files(spark, str(tmp_path / "*"))
    for k in (1, 4):
        mine = sorted((r["group"].rpartition("/")[2], r["t"]) for r in files.uniform_files(found, k).collect())
        assert mine == sorted((f, i + 0.5) for f, n in sizes.items() for i in (range(n) if n <= k else np.linspace(0, n - 1, k).round().astype(int)))
    assert files.uniform_files(found.where("t < 0"), 4).count() == 0


def test_scores_without_error_rows(spark, tmp_path):
    rows = [("x", 1.0, None), ("y", 2.0, "failed"), ("x", 3.0, ""), ("x", 4.0, "late"), ("z", None, None)]
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps({"video_id": v, "score": s} | ({"error": e} if e is not None else {})) + "\n" for v, s, e in rows))
    found = files.without_errors(spark, str(tmp_path / "s.jsonl"), "video_id string, score double, error string", ["video_id"])
    assert {(r["video_id"], r["score"]) for r in found.collect()} == {("x", 3.0), ("z", None)}
    with pytest.raises(PySparkException):
        files.without_errors(spark, str(tmp_path / "none.jsonl"), "video_id string, error string", ["video_id"]).collect()


def test_chunks_without_times(spark):
    c = lambda *rows: [{"start": a, "end": b, "text": t} for a, b, t in rows]
    records = [
        ("timed", 9.0, c((0.0, 1.0, "a"), (1.0, 1.0, "b"), (2.0, 1.5, "c"))),
        ("duration", 9.0, c((None, 1.0, "a"), (None, None, "b"), (None, None, "c"), (3.0, None, None))),
        ("none", None, c((None, None, "a"), (2.0, None, "b"), (None, None, "c"), (None, 5.0, "d"))),
        ("zero", 0.0, c((4.0, None, "a"), (None, 6.0, "b"))),
        ("empty", 3.0, []),
        ("missing", 3.0, None),
    ]
    df = spark.createDataFrame(records, files.TRANSCRIPT)
    want = {}
    for name, d, chunks in records:  # one chunk after the other
        last = 0.0
        for k, x in enumerate(chunks or []):
            s = last if x["start"] is None else x["start"]
            last = (d or s) if x["end"] is None else x["end"]
            if last > s:
                want[name, k] = (s, last, x["text"] or "")
    assert {(r["video_id"], r["position"]): tuple(r)[2:] for r in files.timed_chunks(df).collect()} == want
    assert {(r["video_id"], r["position"]) for r in files.timed_chunks(df, fill=False).collect()} == {("timed", 0)}


def test_finalize_is_gated(spark, tmp_path):
    cohort = spark.createDataFrame([("a",), ("b",)], "video_id string")
    schema = "video_id string, score_curve array<double>, error string"
    good = spark.createDataFrame([("a", [0.1], None), ("b", [0.2], None)], schema)
    assert files.finalize(good, cohort, str(tmp_path / "out")).count() == 2
    bad = spark.createDataFrame([("a", [0.1], "failed"), ("c", [0.2], None)], schema)
    with pytest.raises(ValueError, match="bad.*|missing.*"):
        files.finalize(bad, cohort, str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()


def test_tracks_over_several_batches(spark, tmp_path):
    schema = "gid bigint, label string, t double"
    for k, rows in enumerate([[(1, "a", 0.0), (1, "b", 1.0)], [(1, "a", 5.0), (1, "c", 20.0)], [(1, "a", 21.0), (2, "a", 0.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}.parquet"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*.parquet"))
    found = stateful.drained(stateful.tracks(stream, 10.0, 5), "t", str(tmp_path)).collect()
    assert {(r["gid"], r["label"], r["start"], r["end"], r["n"], r["reason"]) for r in found} == {(1, "a", 0.0, 5.0, 2, "gap"), (1, "b", 1.0, 1.0, 1, "gap")}
    small = stateful.drained(stateful.tracks(stream, 100.0, 1), "u", str(tmp_path)).collect()
    assert {(r["label"], r["reason"]) for r in small} >= {("a", "capacity")}


def test_changes_against_the_row_before(spark, tmp_path):
    schema = "gid bigint, t double, s double"
    spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 1.5), (1, 2.0, 3.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert sorted(r["s"] for r in stateful.drained(stateful.changes(stream, 1.0), "c", str(tmp_path)).collect()) == [1.0, 3.0]


def test_first_arrivals_over_batches_and_after_the_watermark(spark, tmp_path):
    """A key comes once within the delay, whatever the batch; state goes with the watermark, and the key counts anew."""
    schema, day = "k string, ts timestamp, n int", lambda d, h=0: datetime.datetime(2024, 1, d, h)
    for k, rows in enumerate([[("a", day(1), 1), ("b", day(1), 2)], [("a", day(1, 12), 3)], [("c", day(9), 4)], [("c", day(9, 1), 5)], [("a", day(10), 6)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}.parquet"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*.parquet"))
    found = stateful.drained(stateful.first_arrivals(stream, ["k"], delay="1 day").select("k", "n"), "arrivals", str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [("a", 1), ("a", 6), ("b", 2), ("c", 4)]

"""Record files: line records, delimited labels, file-name metadata, audio headers, validated sinks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from chronoloom.operators.ranks import group_rank
from chronoloom.storage import stored

MANIFEST = "dataset string, video_id string, duration double, video_path string, has_video_stream boolean"
PREDICTION = "schema_version int, method string, dataset string, video_id string, duration double, native_rate double, score_curve array<double>, intervals array<array<double>>, error string, calls int, seed int, code_path string, extra string"
TRANSCRIPT = "video_id string, wav_duration double, chunks array<struct<start:double,end:double,text:string>>"
GOLD = "dataset string, video_id string, split string, y array<tinyint>"


def lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines under an explicit schema, plain or gzip."""
    return spark.read.schema(schema).json(path)


def manifest(spark: SparkSession, path: str, datasets: list[str]) -> DataFrame:
    return lines(spark, path, MANIFEST).where(F.col("dataset").isin(datasets))


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array as rows."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file and an ordinal that follows the order in each file: file, ordinal, value."""
    raw = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ordinal"), "value")
    return raw.select("file", "block", "ordinal", "value")


def last_wins(records: DataFrame, key: list[str]) -> DataFrame:
    """The last of each key's records, by (file, block, ordinal)."""
    rest = [c for c in records.columns if c not in (*key, "file", "block", "ordinal")]
    last = F.max_by(F.struct(*rest), F.struct("file", "block", "ordinal"))
    return records.groupBy(*key).agg(last.alias("r")).select(*key, "r.*")


def unique(records: DataFrame, key: list[str]) -> DataFrame:
    """The records, or an error at the first key that occurs twice."""
    first = F.first(F.struct(*[c for c in records.columns if c not in key]))
    counted = records.groupBy(*key).agg(F.count("*").alias("n"), first.alias("r"))
    ok = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("key occurs twice: "), F.concat_ws(",", *key)))).otherwise(F.lit(True))
    return counted.where(ok.cast("boolean")).select(*key, "r.*")


def merged_if_equal(records: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key; an error if its rows disagree."""
    counted = records.groupBy(key).agg(F.count_distinct(F.col(value)).alias("n"), F.min(value).alias(value))
    ok = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("rows disagree: "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return counted.where(ok.cast("boolean")).select(key, value)


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header; a byte order mark before the first name is harmless, as the schema is by position."""
    return spark.read.schema(schema).options(sep=sep, header=True, multiLine=True, escape='"', enforceSchema=True).csv(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed, non-empty lines without byte order mark."""
    value = F.trim(F.regexp_replace("value", "^﻿", ""))
    return spark.read.text(path).select(value.alias("id")).where("id != ''")


def frame_files(spark: SparkSession, path: str) -> DataFrame:
    """Files named frame_SECONDS.ext: path, t; contents aren't read."""
    name = F.regexp_extract("_metadata.file_name", r"frame_([0-9]+(?:\.[0-9]+)?)\.[^.]+$", 1)
    found = spark.read.format("binaryFile").load(path).select(F.col("path"), name.alias("t"))
    return found.where("t != ''").select("path", F.col("t").cast("double").alias("t"))


def uniform_files(found: DataFrame, k: int) -> DataFrame:
    """(group, path, t): k files of each folder of ``frame_files``, evenly spaced in the order of their names, ends included, positions rounded half to even; all files of a folder that has no more. ``group`` is the folder's path."""
    own = found.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("group"), "path", "t")
    sizes = own.groupBy("group").agg(F.count("*").alias("n"))
    at = F.sequence(F.lit(0), F.lit(k - 1))
    even = F.transform(at, lambda i: F.rint(i * ((F.col("n") - 1) / F.lit(max(k - 1, 1)))).cast("long"))
    every = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    picks = sizes.select("group", F.explode(F.when(F.col("n") > k, even).otherwise(every)).alias("_rank"))
    return group_rank(own, ["group"], ["path"], "_rank").join(picks, ["group", "_rank"]).select("group", "path", "t")


def without_errors(spark: SparkSession, path: str, schema: str, key: list[str], error: str = "error") -> DataFrame:
    """The last record of each key among the line records whose error is null or empty; a missing file is an error. ``schema`` names the error column."""
    raw = numbered(spark, path).where(F.trim("value") != "")
    records = raw.select("file", "block", "ordinal", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("file", "block", "ordinal", "r.*")
    return last_wins(records.where(F.coalesce(F.col(error), F.lit("")) == ""), key)


def timed_chunks(transcripts: DataFrame, fill: bool = True) -> DataFrame:
    """(video_id, position, start, end, text) of transcripts (video_id, wav_duration, chunks), empty chunks left out.

    A missing start is the end of the chunk before (0 for the first), a missing end the duration or, where that is missing
    or 0, the start; so ends that were filled count for later starts. Without ``fill`` chunks that lack either are left out.
    """
    c = transcripts.select("video_id", F.when(F.col("wav_duration") != 0, F.col("wav_duration")).alias("d"), F.posexplode("chunks").alias("position", "c")).select("video_id", "d", "position", F.col("c.start").alias("s"), F.col("c.end").alias("e"), F.coalesce("c.text", F.lit("")).alias("text"))
    if not fill:
        return c.where("e > s").select("video_id", "position", F.col("s").alias("start"), F.col("e").alias("end"), "text")
    before = W.partitionBy("video_id").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.coalesce("e", "d", "s"), ignorenulls=True).over(before)  # with a duration every chunk has an end; without one, a chunk that has neither ends where it begins, at the last one's end
    filled = c.withColumn("start", F.coalesce("s", last, F.lit(0.0))).withColumn("end", F.coalesce("e", "d", "start"))
    return filled.where(F.col("end") > F.col("start")).select("video_id", "position", "start", "end", "text")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


AUDIO = "path string, seconds double, rate int, channels int, bits int, problem string"


def _walked(path: str, length: int) -> tuple:
    """Seconds, rate, channels, bits and problem of a file, from the headers of its chunks; what chunks hold is passed over."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    rate = channels = bits = bytes_a_second = None
    with system.open_input_file(name) as f:
        if f.read(4) != b"RIFF" or len(f.read(4)) < 4 or f.read(4) != b"WAVE":
            return None, None, None, None, "no RIFF WAVE header"
        at = 12
        while at + 8 <= length:
            f.seek(at)
            kind, size = struct.unpack("<4sI", f.read(8))
            if kind == b"fmt ":
                own = f.read(min(size, 16))
                if len(own) < 16:
                    return None, None, None, None, "short format chunk"
                _, channels, rate, bytes_a_second, _, bits = struct.unpack("<HHIIHH", own)
            elif kind == b"data":
                if not bytes_a_second:
                    return None, rate, channels, bits, "data before format" if bytes_a_second is None else "no bytes a second"
                return min(size, length - at - 8) / bytes_a_second, rate, channels, bits, None  # a size past the end is that of a stream
            at += 8 + size + size % 2
    return None, rate, channels, bits, "no data chunk"


def audio_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, seconds, rate, channels, bits, or the problem. Tasks read the headers of a file's chunks, wherever these stand, and none of the sound; the file listing doesn't load contents either, and leaves out files of no bytes."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("path", pa.string()), ("seconds", pa.float64()), ("rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("problem", pa.string())]
        for batch in batches:
            rows = [(p, *_walked(p, n)) for p, n in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])

    return spark.read.format("binaryFile").load(path).select("path", "length").mapInArrow(walk, AUDIO)


def wav_durations(spark: SparkSession, path: str) -> DataFrame:
    """path, seconds of the WAV files among the files."""
    return audio_headers(spark, path).where("seconds is not null").select("path", "seconds")


def parted(df: DataFrame, key: str, parsed: Column) -> tuple[DataFrame, DataFrame]:
    """Two tables of one parse, a struct (spans, problems): (key, start, end) of what is good, (key, reason) of what isn't. The parse is written once; an item is in one of the two."""
    held = stored(df.select(key, parsed.alias("p")), "parsed")
    good = held.select(key, F.explode("p.spans").alias("s")).select(key, "s.start", "s.end")
    return good, held.select(key, F.explode("p.problems").alias("reason"))


def even_lists(df: DataFrame, key: str, lists: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of parallel lists as one row a position (key, position, and a column a list), and (key, reason) of rows whose lists differ in length or are missing. A row is in one of the two."""
    held = stored(df.select(key, *lists), "lists")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in lists]))
    lengths = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.size(c).cast("string")) for c in lists])
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ","))).when(F.size(F.array_distinct(F.array(*[F.size(c) for c in lists]))) > 1, F.concat(F.lit("lengths:"), lengths))
    judged = held.withColumn("_reason", reason)
    good = judged.where("_reason is null").select(key, F.posexplode(F.arrays_zip(*lists)).alias("position", "z")).select(key, "position", *[F.col("z")[c].alias(c) for c in lists])
    return good, judged.where("_reason is not null").select(key, F.col("_reason").alias("reason"))


def finalize(predictions: DataFrame, cohort: DataFrame, path: str, key: str = "video_id") -> DataFrame:
    """Write predictions only if they cover the cohort exactly and no record failed; else an error that counts what is wrong."""
    missing = cohort.select(key).join(predictions, key, "left_anti").select(F.lit("missing").alias("kind"))
    extra = predictions.join(cohort, key, "left_anti").select(F.lit("extra").alias("kind"))
    bad = predictions.where(F.col("error").isNotNull() | (F.size("score_curve") < 1)).select(F.lit("bad").alias("kind"))
    wrong = {r["kind"]: r["count"] for r in missing.unionByName(extra).unionByName(bad).groupBy("kind").count().collect()}  # three rows at most
    if wrong:
        raise ValueError(f"predictions not written: {wrong}")
    predictions.write.mode("overwrite").json(path)
    return predictions.sparkSession.read.schema(predictions.schema).json(path)


def pending(cohort: DataFrame, done: DataFrame, key: str = "video_id") -> DataFrame:
    """Keys without a finished record; a later failure un-finishes a key."""
    last = last_wins(done, [key])
    return cohort.join(last.where("error is null"), key, "left_anti")

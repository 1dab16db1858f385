"""Tables in the shared folder, which cut lineage.

The folder is the one that ``spark.checkpoint.dir`` names in the session, so a
lost executor costs a re-read, not a recomputation. It has to be visible to the
driver and all executors; only a local session without the setting gets a folder
of its own. A path without a scheme belongs to Spark's default file system.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme and host of the file system that Spark finds it in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.toUri().getScheme():
        return path
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    return target.makeQualified(spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(hadoop), spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/")).toString()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder with its scheme."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return qualified(spark, configured.rstrip("/"))
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
    return _local_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_path = path
    return back


def written(spark: SparkSession) -> list[str]:
    """Paths that this application has written and not deleted."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete paths that this application has written."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    own = _written.get(spark.sparkContext.applicationId, [])
    for path in paths:
        if path in own:
            own.remove(path)
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(hadoop).delete(target, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_stored_path", None):
            delete(df.sparkSession, [path])


def drop_stored(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder."""
    delete(spark, written(spark))

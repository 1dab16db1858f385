"""Small helpers for the corpus operators. Tables that cut lineage are those of ``chronoloom.storage``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.storage import delete, drop, drop_stored, fresh_path, shared_dir, stored, written

__all__ = ["arrow_function", "delete", "drop", "drop_stored", "fresh_path", "let", "shared_dir", "stored", "table", "unused", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be new to ``df`` in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value, body):
    """Bind ``value`` once and use it several times in ``body`` without re-evaluation."""
    return F.transform(F.array(value), body)[0]


def arrow_function(kind: str):
    """Decorate a function on batches of Arrow arrays as a column function of type ``kind``. The type is parsed at the call, on the driver, as executors import these modules without a session."""

    def wrap(on_batches):
        def on_columns(*columns):
            return F.arrow_udf(on_batches, kind)(*columns)

        return on_columns

    return wrap

"""The state store of streams."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession):
    """The state store that keyed state of several values needs, for the streams begun inside."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)

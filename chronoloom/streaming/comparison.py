"""Token streams: each token compared with the same token of the frame before, then grouped frame by frame.

State is one vector a token of a series, kept under (gid, token) by the state
store, so a series with most of the stream's rows is dealt over its tokens; a
restart goes on from the checkpoint. Frames of a series come in order, and a
frame's rows come in one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronoloom.operators.tokens import GROUPS, Grouping, grouped

COMPARED = "gid bigint, token bigint, frame bigint, n int, v array<double>, salience double, static boolean"
COLUMNS = [c.split()[0] for c in COMPARED.split(", ")]


class Comparison(StatefulProcessor):
    """Marks rows whose vector is near that of the frame before."""

    def __init__(self, how: Grouping):
        self.how = how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "frame bigint, n int, v array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("frame")  # a token's rows of one batch
        held = self.before.get() if self.before.exists() else None
        out = []
        for frame, n, v, salience in zip(own["frame"], own["n"], own["v"], own["salience"], strict=True):
            x = np.asarray(v, dtype=float)
            static = False
            if held is not None and held[0] == frame - 1 and held[1] == n:
                y = np.asarray(held[2], dtype=float)
                norm = np.sqrt((x @ x) * (y @ y))
                static = bool(norm > 0 and x @ y / norm > self.how.similarity)
            held = (int(frame), int(n), x.tolist())
            out.append((key[0], key[1], held[0], held[1], held[2], float(salience), static))
        if held is not None:
            self.before.update(held)
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def compared(tokens: DataFrame, how: Grouping = Grouping()) -> DataFrame:
    """A stream of tokens with ``static``. The session's state store has to be RocksDB's."""
    return tokens.groupBy("gid", "token").transformWithStateInPandas(Comparison(how), COMPARED, "Append", "None")


def drained_groups(tokens: DataFrame, path: str, how: Grouping = Grouping()) -> DataFrame:
    """Run the stream over what is there now, batch by batch; groups of all frames as a table under ``path``. A batch that is run again replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        grouped(batch, how).write.mode("overwrite").parquet(f"{path}/groups/batch={number}")

    query = compared(tokens, how).writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/marks").trigger(availableNow=True).start()
    query.awaitTermination()
    return tokens.sparkSession.read.schema(GROUPS).option("recursiveFileLookup", "true").parquet(f"{path}/groups")

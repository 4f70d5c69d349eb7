"""The keyed and row-wise operators over streams of sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators import cluster as C


def exact_duplicates(records: DataFrame, time: str, late: str) -> DataFrame:
    """A stream of sequences without those whose letters came before, within ``late`` of event time."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark(["seq"])


def screen(records: DataFrame, references: DataFrame, identity: float, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, kind: str = "protein") -> StreamingQuery:
    """Each micro-batch of a stream of sequences screened against fixed references; ``sink`` gets the matches and the batch's number.

    Rows are independent, so a batch gives what a table of the same rows would.
    """

    def batch(rows: DataFrame, number: int) -> None:
        sink(C.screen(rows, references, identity, k, kind), number)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()

"""Scanning sources as they arrive: facts and detectors need one file only, so a stream needs no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def scan(sources: DataFrame, detect: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Findings of each micro-batch as Parquet under out, one folder a batch, so that a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        detect(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return sources.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Row-wise operators work on streaming tables as they are; this package adds the sink for grouped ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict | None = None):
    """Apply an operator to every micro-batch and append its result as Parquet; gives the running query.

    A batch that is retried overwrites its own folder, so results come once.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""Requirements as a stream: each micro-batch goes through the batch flow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kilnwork.model import REQUIREMENT


def stream_requirements(spark: SparkSession, path: str, flow: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Appends ``flow(batch)`` for the JSON files that arrive in ``path`` to the table at ``out``; a batch that is run again overwrites its own part."""

    def write(batch: DataFrame, batch_id: int) -> None:
        flow(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return spark.readStream.schema(REQUIREMENT).json(path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Incremental build as a stream: new lap files in, finished sessions stored and marked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stintwise.schema import SESSION
from stintwise.sources.dataset import build_pending


def stream_sessions(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    build: Callable[[DataFrame], DataFrame],
    dataset_path: str,
    manifest_path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Process what has landed and stop.

    The unit is a whole session, so a batch only says which sessions arrived; their rows are
    rebuilt from the stored inputs, also when more of a session that was built before has landed.
    A batch that is replayed overwrites its sessions with the same rows.
    """

    def on_batch(batch: DataFrame, _batch_id: int) -> None:
        build_pending(batch.select(*SESSION).distinct(), build, dataset_path, manifest_path, force=True)

    return (
        spark.readStream.schema(schema)
        .parquet(landing)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

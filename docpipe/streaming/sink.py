"""Micro-batch sinks that a replay cannot double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def replace_batch(rows: DataFrame, path: str, epoch: int, *partitions: str) -> None:
    """Write one micro-batch below its own ``epoch`` folder, replacing an earlier try."""
    (
        rows.withColumn("epoch", F.lit(epoch).cast("bigint"))
        .write.mode("overwrite").options(partitionOverwriteMode="dynamic", compression="zstd")
        .partitionBy("epoch", *partitions).parquet(path)
    )


def run_to_end(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, output_mode: str = "append"
) -> StreamingQuery:
    """Process everything available now in micro-batches, then stop."""
    query = (
        stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(work).start()
    )
    query.awaitTermination()
    return query

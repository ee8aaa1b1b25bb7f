"""Where a stream ends: appended files, or a table kept up to date by key."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skillstrata.operators.relate import latest_by_key


def sink_files(s: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to a Parquet folder, takes what is there and stops."""
    writer = s.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def sink_upsert(
    s: DataFrame, path: str, key: Sequence[str], checkpoint: str, version: str | None = None, mode: str = "append"
) -> StreamingQuery:
    """Keeps the last row of each key.

    A micro-batch writes its own changes under ``run=R/batch_id=N`` and nothing else, so its cost
    does not grow with the table and a replayed batch replaces itself. R stands for the
    checkpoint: a query with a new one, whose batches are counted from 0 again, writes beside
    the old log. ``read_upserted`` merges on read. Within a batch the row with the highest ``version`` is kept; with none
    given, the batch must hold a key once, as an aggregate in update mode does.
    """

    run = hashlib.md5(checkpoint.encode()).hexdigest()

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = latest_by_key(batch, key, version) if version else batch
        rows.withColumn("_written", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/run={run}/batch_id={batch_id}")

    writer = s.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.outputMode(mode).trigger(availableNow=True).start()


def read_upserted(spark: SparkSession, path: str, key: Sequence[str], version: str | None = None) -> DataFrame:
    """Current rows of a table ``sink_upsert`` writes: of a key the highest version, or the row written last."""
    rows = spark.read.parquet(path)
    order = F.struct(*([version] if version else []), "_written", "batch_id")
    return latest_by_key(rows.withColumn("_order", order), key, "_order").drop("run", "batch_id", "_written", "_order")


def compact_upserted(
    spark: SparkSession, path: str, compact_path: str, key: Sequence[str], version: str | None = None
) -> None:
    """Writes the current rows as one batch to a new path, to be read in place of the old."""
    current = read_upserted(spark, path, key, version).withColumn("_written", F.current_timestamp())
    current.write.mode("overwrite").parquet(f"{compact_path}/run=compacted/batch_id=0")

"""Relational sink for Gold results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SHARD, SHARDS = "shard_no", 8


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    props: Mapping[str, str] | None = None,
    skip: bool = False,
    connections: int = 8,
    shard_by: Sequence[str] = (),
) -> bool:
    """Replaces the rows of a table; returns whether it was written.

    ``connections`` is how many tasks write at once, which the database has to bear. ``shard_by`` adds
    a column with the hash of some columns, from 0 to SHARDS - 1, on which a read can be split
    whatever the types of the table's keys.
    """
    if skip:
        return False
    if shard_by:
        df = df.withColumn(SHARD, F.pmod(F.xxhash64(*shard_by), F.lit(SHARDS)).cast("int"))
    options = {"truncate": "true", "batchsize": "5000", "numPartitions": str(connections), **(props or {})}
    df.write.format("jdbc").mode("overwrite").option("url", url).option("dbtable", table).options(**options).save()
    return True


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    props: Mapping[str, str] | None = None,
    split_on: str | None = None,
    bounds: tuple[int, int] | None = None,
    connections: int = 8,
) -> DataFrame:
    """Reads a table, in parallel ranges of the numeric column ``split_on`` where given.

    Split on SHARD, the ranges are known and the column is left out of the result; any other
    column needs the ``bounds`` of its values, without which most rows would be in one range.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(props or {}))
    if not split_on:
        return reader.load()
    if split_on.lower() == SHARD:
        bounds = (0, SHARDS)
    if bounds is None:
        raise ValueError(f"give the bounds of {split_on}")
    reader = reader.options(partitionColumn=split_on, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=connections)
    found = reader.load()
    return found.drop(split_on) if split_on.lower() == SHARD else found

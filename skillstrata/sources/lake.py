"""Lake layers: Parquet folders below one root, on any file system Spark can name."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BRONZE, SILVER, GOLD = "bronze", "silver", "gold"
CODEC = "zstd"  # of stored tables: half the bytes of the default for fingerprints and ids in hexadecimal


def layer_path(root: str, layer: str, table: str) -> str:
    return f"{root.rstrip('/')}/{layer}/{table}"


def write_layer(
    df: DataFrame,
    root: str,
    layer: str,
    table: str,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    gather: bool = True,
    keep_partitions: bool = False,
) -> str:
    """Writes one table in place of what is there and returns its path.

    With ``keep_partitions`` only the partitions of ``df`` are replaced and others stay.
    With ``gather`` a rebalance shuffle brings the rows of a partition into few files and
    splits a partition that holds much of the table over several tasks. Leave it out where
    there are few partitions, or the rows come in by partition already: each task then
    writes a file to every partition it has rows of. ``sort_by`` gives row groups narrow
    value ranges for lookups.
    """
    path = layer_path(root, layer, table)
    out = df
    if partition_by and gather:
        out = out.hint("rebalance", *partition_by)
    if partition_by or sort_by:
        out = out.sortWithinPartitions(*partition_by, *sort_by)
    writer = out.write.mode("overwrite").option("compression", CODEC).option("partitionOverwriteMode", "dynamic" if keep_partitions else "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def at_once(writes: Iterable[Callable[[], object]], limit: int = 6) -> None:
    """Runs writes that do not depend on each other side by side.

    Spark then fills cores that the last tasks of one leave idle with tasks of the next.
    """
    with ThreadPoolExecutor(limit) as pool:
        for done in [pool.submit(write) for write in writes]:
            done.result()


def read_layer(
    spark: SparkSession, root: str, layer: str, table: str, schema: StructType | str | None = None
) -> DataFrame:
    """Reads one table of a layer."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(layer_path(root, layer, table))

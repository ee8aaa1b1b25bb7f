"""Small helpers shared by the operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillstrata.session import scratch

# A word: anything between blanks, tabs, line feeds, vertical tabs, form feeds and returns.
# bytes.split() without arguments splits at exactly these six characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
# A batch lies in buffers of the JVM and of the worker, several times over and once for each core.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_words(text: str | Column) -> Column:
    """Number of words as long; NULL counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def without(df: DataFrame, *added: str) -> DataFrame:
    """The frame less any columns the caller is about to add: added columns win over clashing ones."""
    clash = {name.lower() for name in added}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in clash])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: lineage is cut, executors may go."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI with the file system it is on, which is the cluster's default where it names none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def forget(*tables: DataFrame) -> None:
    """Deletes the folders of ``stored`` tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        folders = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """Texts of a batch, NULL as empty."""
    return [text or "" for text in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        at = batch.schema.get_field_index(name)
        start = size = 0
        for row, length in enumerate(pa.compute.binary_length(batch.column(at)).to_pylist()):
            size += length or 0
            if size >= limit:
                yield batch.slice(start, row + 1 - start)
                start, size = row + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
        give_back()


def give_back() -> None:
    """What the last batch took goes back to the system: workers live on beside other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def workers_find_package(spark: SparkSession) -> None:
    """Puts the folder of this package on the Python path of the session's workers, and bounds the batches they get.

    Enough where workers share the driver's disk; on a cluster, submit the package with --py-files.
    A batch is else bounded by its rows alone, however long their texts; a bound that the session has stays.
    """
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])

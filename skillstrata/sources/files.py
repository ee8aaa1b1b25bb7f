"""CSV in and out, field unification, run summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS_PER_FILE = 200_000

# Spark's CSV defaults trim blanks on write and read '' back as NULL; these keep the text whole.
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_csv(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = True) -> DataFrame:
    """CSV with an explicit schema.

    A file whose header names other columns, or the same in another order, is an error: by
    position its values would land in the wrong columns.

    Descriptions hold line breaks, hence ``multi_line``; with it each file is one task. Turn
    it off for feeds of large files without line breaks in a field, which Spark then splits.
    """
    reader = spark.read.schema(schema).options(**CSV_OPTIONS).option("mode", "PERMISSIVE").option("enforceSchema", "false")
    return reader.option("multiLine", str(multi_line).lower()).csv(path)


def write_csv(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, *, compression: str = "none") -> None:
    """CSV as a folder of part files of bounded size, as a file with line breaks in fields is one task to read."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).option("maxRecordsPerFile", rows_per_file).csv(path, compression=compression)


def read_source(
    spark: SparkSession, glob: str, source: str, schema: StructType | str, multi_line: bool = True
) -> DataFrame:
    """All CSV files of one platform, each row with ``source`` and ``source_file``."""
    rows = read_csv(spark, glob, schema, multi_line)
    return rows.select("*", F.lit(source).alias("source"), F.col("_metadata.file_path").alias("source_file"))


def file_census(raw: DataFrame) -> DataFrame:
    """Files and rows of each source.

    Counted by file first, so a source with most of the rows is not one group.
    """
    by_file = raw.groupBy("source", "source_file").agg(F.count("*").alias("_rows"))
    return by_file.groupBy("source").agg(F.count("source_file").alias("files"), F.sum("_rows").alias("rows"))


def with_posting_key(df: DataFrame) -> DataFrame:
    """``record_id`` made unique over platforms: the platform and its own id. A posting without an id keeps none."""
    return df.withColumn("record_id", F.concat("source", F.lit(":"), F.col("record_id").cast("string")))


def fuse_sources(sources: Sequence[tuple[DataFrame, Mapping[str, str]]], keyed: bool = False) -> DataFrame:
    """Renames each source's columns to the common ones and stacks the sources.

    The mapping is ``{column of the source: common column}``; others keep their names, and
    a column one source lacks is NULL there. ``keyed`` makes the platforms' own ids, which may
    clash, into posting keys; leave it out where ids are unique over all of them already.
    """
    renamed = [df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns]) for df, names in sources]
    fused = renamed[0]
    for other in renamed[1:]:
        fused = fused.unionByName(other, allowMissingColumns=True)
    return with_posting_key(fused) if keyed else fused


def write_unified(df: DataFrame, path: str) -> None:
    """The fused table as CSV."""
    write_csv(df, path)


def read_unified(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = True) -> DataFrame:
    """The fused table back from CSV."""
    return read_csv(spark, path, schema, multi_line)


def write_summary(summary: DataFrame, path: str) -> None:
    """A run summary, one row, as JSON."""
    summary.write.mode("overwrite").json(path)

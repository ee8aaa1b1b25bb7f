"""Gold refresh for the months a batch touches.

Gold that is refreshed is kept in parts, one partition for each month of Silver. A refresh
reads and rewrites the touched months only; results over all months are put together from
the parts, which are far smaller than Silver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillstrata.operators.gold import salary_values
from skillstrata.sources.lake import GOLD, layer_path, read_layer, write_layer

MONTH = "posted_month"
NO_MONTH_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def job_skill_part(p: DataFrame) -> DataFrame:
    """Posting-skill relation by month."""
    return p.select("record_id", F.explode("skills").alias("skill"), MONTH)


def salary_part(p: DataFrame) -> DataFrame:
    """Salary values of each city by month; ``salary_figures`` adds them up."""
    return salary_values(p, (MONTH, "city"))


def role_part(p: DataFrame) -> DataFrame:
    """Postings of each role by month."""
    return p.groupBy(MONTH, "role").agg(F.count("*").alias("postings"))


def write_parts(p: DataFrame, root: str, table: str, part: Callable[[DataFrame], DataFrame]) -> str:
    """Writes a Gold table by month. The relation comes in Silver's own layout and needs no shuffle."""
    return write_layer(part(p), root, GOLD, table, [MONTH], gather=part is not job_skill_part, keep_partitions=True)


def in_months(months: list[int | None]) -> Column:
    """Rows of the months, where None stands for postings without a date."""
    hit = F.col(MONTH).isin([m for m in months if m is not None])
    return hit | F.col(MONTH).isNull() if None in months else hit


def refresh_gold(
    spark: SparkSession, root: str, table: str, batch: DataFrame, p: DataFrame, part: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Brings a Gold table kept by month in line with ``p`` and returns it.

    ``p`` is Silver after the batch; ``batch`` holds the rows that came, went or changed,
    changed ones in both versions, so that a month that lost a posting counts as touched.
    """
    # One number for each month; the filter below prunes Silver to these partitions.
    touched = [r[0] for r in batch.select(MONTH).distinct().collect()]
    if touched:
        schema = read_layer(spark, root, GOLD, table).drop(MONTH).schema
        current = p.filter(in_months(touched))
        left = {r[0] for r in part(current).select(MONTH).distinct().collect()}
        write_parts(current, root, table, part)
        # An overwrite leaves a partition it has no row for; those are emptied one by one.
        for month in [m for m in touched if m not in left]:
            folder = NO_MONTH_FOLDER if month is None else month
            nothing = spark.createDataFrame([], schema)
            nothing.write.mode("overwrite").parquet(f"{layer_path(root, GOLD, table)}/{MONTH}={folder}")
    return read_layer(spark, root, GOLD, table)

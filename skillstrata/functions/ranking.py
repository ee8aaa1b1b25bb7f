"""Ranking and totals that keep to bounded groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_rank_desc(df: DataFrame, value: str, rank: str) -> DataFrame:
    """Exact dense rank of a positive BIGINT column, highest value first.

    A window over the whole table would run in one task. Instead the distinct values are
    ranked inside bands of equal bit length; the offsets of the at most 64 bands are the
    only thing ranked without a key.
    """
    levels = df.select(value).distinct().withColumn("_band", F.length(F.bin(F.col(value))))
    bands = levels.groupBy("_band").agg(F.count("*").alias("_size"))
    above = Window.orderBy(F.col("_band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = bands.select("_band", F.coalesce(F.sum("_size").over(above), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_band").orderBy(F.col(value).desc())
    ranked = (
        levels.withColumn("_place", F.row_number().over(within))
        .join(offsets, "_band")
        .select(value, (F.col("_offset") + F.col("_place")).cast("bigint").alias(rank))
    )
    return df.join(ranked, value)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], top_n: int | None) -> DataFrame:
    """First ``top_n`` rows of each group.

    The rank filter is pushed below the shuffle, so a hot group sends at most ``top_n``
    rows per map task.
    """
    if top_n is None:
        return df
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= top_n).drop("_place")


def share_of_total(part: Column, total: DataFrame) -> Column:
    """``part`` over the single number in ``total``, read as a scalar subquery."""
    return part.cast("double") / F.nullif(total.scalar().cast("double"), F.lit(0.0))

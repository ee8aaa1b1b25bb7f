"""Demand over time and city comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillstrata.functions.ranking import share_of_total
from skillstrata.operators.gold import midpoint, posting_count


def month_index(day: Column) -> Column:
    """Months since year 0, so that neighbouring months differ by one."""
    return (F.year(day) * 12 + F.month(day) - 1).cast("bigint")


def month_name(index: Column) -> Column:
    """``yyyy-MM`` of a month index."""
    year = F.floor(index / F.lit(12)).cast("int")
    return F.format_string("%04d-%02d", year, F.pmod(index, F.lit(12)).cast("int") + 1)


def monthly(df: DataFrame, *keys: str) -> DataFrame:
    """Postings of each key and month; the later windows see one row for each of these."""
    dated = df.filter(F.col("posted_on").isNotNull()).withColumn("_m", month_index(F.col("posted_on")))
    return dated.groupBy(*keys, "_m").agg(F.count("*").alias("postings"))


def every_month(counted: DataFrame, key: str) -> DataFrame:
    """``(key, _m, postings)`` with a line for each month from a key's first to its last, zero where it has none."""
    spans = counted.groupBy(key).agg(F.min("_m").alias("_first"), F.max("_m").alias("_last"))
    months = spans.select(key, F.explode(F.sequence("_first", "_last")).alias("_m"))
    known = counted.select(F.col(key).alias("_key"), F.col("_m").alias("_at"), "postings")
    joined = months.join(known, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_m") == F.col("_at")), "left")
    return joined.select(key, "_m", F.coalesce("postings", F.lit(0).cast("long")).alias("postings"))


def role_trend(p: DataFrame) -> DataFrame:
    """Postings of each role and month, from its first to its last, and the change against the month before.

    A month without postings has a line with zero; the first month of a role has no change.
    """
    in_order = Window.partitionBy("role").orderBy("_m")
    trend = every_month(monthly(p, "role"), "role").withColumn("_prior", F.lag("postings").over(in_order))
    return trend.select(
        "role",
        month_name(F.col("_m")).alias("month"),
        "postings",
        F.col("_prior").cast("bigint").alias("prior_postings"),
        (F.col("postings") - F.col("_prior")).cast("bigint").alias("change"),
    )


def skill_trend(p: DataFrame) -> DataFrame:
    """Postings of each skill and month, from its first to its last, and their sum over the last three months."""
    last_three = Window.partitionBy("skill").orderBy("_m").rangeBetween(-2, 0)
    counted = every_month(monthly(p.select("posted_on", F.explode("skills").alias("skill")), "skill"), "skill")
    return counted.select(
        "skill",
        month_name(F.col("_m")).alias("month"),
        "postings",
        F.sum("postings").over(last_three).alias("postings_3m"),
    )


def city_comparison(p: DataFrame, cities: Sequence[str] | None = None) -> DataFrame:
    """Size of the market of each city: postings, roles, companies, mean salary."""
    own = p.filter(F.col("city").isNotNull() if cities is None else F.col("city").isin(list(cities)))
    total = F.sum(midpoint().cast("decimal(18,2)")).cast("double")
    return own.groupBy("city").agg(
        F.count("*").alias("postings"),
        F.count_distinct("role").alias("roles"),
        F.count_distinct("company").alias("companies"),
        (total / F.nullif(F.count("salary_min"), F.lit(0))).alias("mean_mid"),
    )


def city_role_matrix(p: DataFrame) -> DataFrame:
    """Postings of each role in each city and their share of the city, in long form."""
    counted = p.filter(F.col("city").isNotNull()).groupBy("city", "role").agg(F.count("*").alias("postings"))
    totals = counted.groupBy("city").agg(F.sum("postings").alias("_all"))
    return counted.join(totals, "city").select(
        "city", "role", "postings", (F.col("postings").cast("double") / F.col("_all")).alias("share")
    )


def city_skill_diff(p: DataFrame, a: str, b: str) -> DataFrame:
    """Postings of each skill in two cities side by side."""
    both = p.filter(F.col("city").isin(a, b)).select("city", F.explode("skills").alias("skill"))
    in_a, in_b = F.count_if(F.col("city") == a), F.count_if(F.col("city") == b)
    return both.groupBy("skill").agg(
        in_a.alias("postings_a"), in_b.alias("postings_b"), (in_a - in_b).alias("difference")
    )


def city_distribution(p: DataFrame) -> DataFrame:
    """Postings of each city and their share of all that have a city."""
    known = p.filter(F.col("city").isNotNull())
    counted = known.groupBy("city").agg(F.count("*").alias("postings"))
    return counted.withColumn("share", share_of_total(F.col("postings"), posting_count(known)))

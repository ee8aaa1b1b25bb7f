"""Gold tables out of Silver postings.

Silver carries the sorted distinct skills of a posting as an array, so every skill count is
an explode and a partial aggregate; nothing is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillstrata.functions.ranking import dense_rank_desc, share_of_total


def posting_count(p: DataFrame) -> DataFrame:
    """One row with the number of postings."""
    return p.agg(F.count("*").alias("n"))


def midpoint() -> Column:
    """Middle of the monthly salary range."""
    return (F.col("salary_min") + F.col("salary_max")) / F.lit(2.0)


def gold_job_skill(p: DataFrame) -> DataFrame:
    """Posting-skill relation. Record ids are unique and skills distinct, so no shuffle is needed."""
    return p.select("record_id", F.explode("skills").alias("skill"))


def gold_skill_freq(js: DataFrame, p: DataFrame) -> DataFrame:
    """Postings, share of all postings and dense rank of each skill."""
    counted = js.groupBy("skill").agg(F.count("*").alias("postings"))
    ranked = dense_rank_desc(counted, "postings", "rank")
    return ranked.select(
        "skill", "postings", share_of_total(F.col("postings"), posting_count(p)).alias("share"), "rank"
    )


def salary_values(p: DataFrame, by: Sequence[str] = ("city",)) -> DataFrame:
    """How often each salary midpoint occurs; parts of it can be added up by ``salary_figures``."""
    known = p.filter(F.col("salary_min").isNotNull()).withColumn("mid", midpoint())
    return known.groupBy(*by, "mid").agg(
        F.count("*").alias("n"), F.min("salary_min").alias("low"), F.max("salary_max").alias("high")
    )


def salary_figures(values: DataFrame, by: Sequence[str] = ("city",)) -> DataFrame:
    """Postings, lowest, highest, mean and exact median out of ``salary_values``."""
    weighted = (F.col("mid") * F.col("n")).cast("decimal(28,2)")
    return values.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.min("low").alias("salary_min"),
        F.max("high").alias("salary_max"),
        (F.sum(weighted).cast("double") / F.sum("n")).alias("mean_mid"),
        F.percentile("mid", F.lit(0.5), F.col("n")).alias("median_mid"),
    )


def gold_city_salary(p: DataFrame, by: Sequence[str] = ("city",)) -> DataFrame:
    """Postings with a salary, lowest, highest, mean and median midpoint.

    Salaries are counted by value before the shuffle; the exact median then weighs distinct
    values, so a city with most of the rows costs no more than its range of salaries.
    """
    return salary_figures(salary_values(p, by), by)


def gold_role_demand(p: DataFrame) -> DataFrame:
    """Postings, companies, cities and share of all postings of each role."""
    counted = p.groupBy("role").agg(
        F.count("*").alias("postings"),
        F.count_distinct("company").alias("companies"),
        F.count_distinct("city").alias("cities"),
    )
    return counted.withColumn("share", share_of_total(F.col("postings"), posting_count(p)))

"""Warehouse database: external tables over the lake, views on top."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import SparkSession

from skillstrata.sources.lake import BRONZE, GOLD, SILVER, layer_path, read_layer


class ExternalTable(NamedTuple):
    name: str
    layer: str
    table: str
    partition_by: Sequence[str] = ()


# ODS holds what was collected, DWD the cleaned rows, DWS relations, ADS results.
TABLES = (
    ExternalTable("ods_posting", BRONZE, "posting", ("batch", "source")),
    ExternalTable("dwd_posting", SILVER, "posting", ("posted_month",)),
    ExternalTable("dwd_posting_text", SILVER, "posting_text"),
    ExternalTable("dws_job_skill", GOLD, "job_skill"),
    ExternalTable("ads_skill_freq", GOLD, "skill_freq"),
    ExternalTable("ads_city_salary", GOLD, "city_salary"),
    ExternalTable("ads_role_demand", GOLD, "role_demand"),
)


def register_warehouse(
    spark: SparkSession, root: str, db: str, tables: Sequence[ExternalTable] = TABLES, location: str | None = None
) -> None:
    """Creates the database and its external tables; the files stay where they are.

    The schema comes from the written files; partitions are found by ``MSCK REPAIR TABLE``.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{location or root + '/warehouse'}'")
    for spec in tables:
        fields = read_layer(spark, root, spec.layer, spec.table).schema.fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        partitioned = f"PARTITIONED BY ({', '.join(spec.partition_by)})" if spec.partition_by else ""
        name = f"{db}.{spec.name}"
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet {partitioned} "
            f"LOCATION '{layer_path(root, spec.layer, spec.table)}'"
        )
        if spec.partition_by:
            spark.sql(f"MSCK REPAIR TABLE {name}")


def warehouse_views(spark: SparkSession, db: str) -> None:
    """Views over the tables: a role-skill relation and a one-line-per-role report."""
    spark.sql(
        f"""CREATE OR REPLACE VIEW {db}.dws_role_skill AS
        SELECT role, skill, count(*) AS postings
        FROM (SELECT role, explode(skills) AS skill FROM {db}.dwd_posting)
        GROUP BY role, skill"""
    )
    spark.sql(
        f"""CREATE OR REPLACE VIEW {db}.ads_role_report AS
        SELECT d.role, d.postings, d.share, count(s.skill) AS skills, max(s.postings) AS top_skill_postings
        FROM {db}.ads_role_demand d LEFT JOIN {db}.dws_role_skill s ON s.role = d.role
        GROUP BY d.role, d.postings, d.share"""
    )

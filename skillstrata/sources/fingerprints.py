"""Index of the fingerprints that Silver holds, bucketed so that a batch meets it where it lies.

One narrow row for each posting ever taken into Silver: the table is appended to, and of the rows of
one fingerprint the best placed is the posting that is stored. Buckets are by fingerprint, so
neither the join with a batch nor the minimum over a fingerprint moves a stored row. Take at
least as many buckets as shuffle partitions; with fewer the planner deals the index anew.
"""

from __future__ import annotations

from collections.abc import Mapping
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillstrata.operators.clean import priority_of
from skillstrata.sources.lake import CODEC, SILVER, layer_path

N_BUCKETS = 256
COLUMNS = ("fingerprint", "record_id", "source")


def place_of(priority: Mapping[str, int]) -> Column:
    """What decides which posting of a fingerprint stays: the least of these."""
    return F.struct(priority_of(F.col("source"), priority).alias("priority"), "record_id", "source")


def register(spark: SparkSession, root: str, n_buckets: int = N_BUCKETS) -> str:
    """The name of the index in this session's catalog; its files are below ``root``, whatever the session."""
    name = f"fingerprints_{md5(root.encode()).hexdigest()}"
    path = layer_path(root, SILVER, "fingerprints").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (fingerprint STRING, record_id STRING, source STRING) USING parquet OPTIONS (compression '{CODEC}') "
        f"CLUSTERED BY (fingerprint) SORTED BY (fingerprint) INTO {n_buckets} BUCKETS LOCATION '{path}'"
    )
    return name


def add(spark: SparkSession, root: str, postings: DataFrame, n_buckets: int = N_BUCKETS) -> None:
    """Enters postings. They are dealt by bucket first, so a bucket gets one file."""
    dealt = postings.select(*COLUMNS).repartition(n_buckets, "fingerprint")
    dealt.write.insertInto(register(spark, root, n_buckets))


def against_index(spark: SparkSession, root: str, postings: DataFrame, priority: Mapping[str, int], n_buckets: int = N_BUCKETS) -> DataFrame:
    """The postings that Silver lacks or holds in a worse placed copy, with ``replaces`` for the latter.

    ``postings`` has one row for a fingerprint. A posting that is stored already is not given.
    """
    known = spark.table(register(spark, root, n_buckets)).groupBy("fingerprint").agg(F.min(place_of(priority)).alias("_known"))
    met = postings.join(known, "fingerprint", "left")
    better = F.col("_known").isNull() | (place_of(priority) < F.col("_known"))
    return met.where(better).withColumn("replaces", F.col("_known").isNotNull()).drop("_known")

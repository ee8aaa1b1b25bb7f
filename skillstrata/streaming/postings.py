"""Posting stream: source, cleaning, dedup, heat windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skillstrata.dictionaries import Dictionaries
from skillstrata.operators.clean import valid_rows, with_fingerprint
from skillstrata.plans.lake_build import refine

JSON_FORMATS = ("kafka", "text")
SALTS = 32


def posting_stream(spark: SparkSession, fmt: str, options: Mapping[str, str], schema: StructType | str) -> DataFrame:
    """Stream of records: JSON in the ``value`` of Kafka messages or text lines, or files of any format."""
    reader = spark.readStream.format(fmt).options(**options)
    if fmt not in JSON_FORMATS:
        return reader.schema(schema).load()
    record = F.from_json(F.col("value").cast("string"), schema).alias("_record")
    return reader.load().select(record).select("_record.*")


def clean_stream(s: DataFrame, dicts: Dictionaries) -> DataFrame:
    """Raw postings of a stream in Silver form.

    Give the skills as a list: a DataFrame is joined with an aggregate, which a stream cannot append.
    """
    return refine(with_fingerprint(valid_rows(s)), dicts)


def dedup_stream(s: DataFrame, event_time: str, delay: str, row_id: str = "record_id", salts: int = SALTS) -> DataFrame:
    """First row of each fingerprint within ``delay``.

    Rows of one fingerprint meet in one state partition. The first step works on the
    fingerprint and a salt, so that a fingerprint with much of the traffic is spread over
    ``salts`` of them; the second sees at most ``salts`` rows of it.
    """
    salted = s.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)))
    marked = salted.withWatermark(event_time, delay)
    thinned = marked.dropDuplicatesWithinWatermark(["fingerprint", "_salt"])
    return thinned.dropDuplicatesWithinWatermark(["fingerprint"]).drop("_salt")


def heat_stream(
    s: DataFrame, event_time: str, keys: Sequence[str], size: str, slide: str | None = None, *, delay: str
) -> DataFrame:
    """Rows of each key in tumbling or sliding event-time windows.

    ``delay`` is the caller's to choose: rows later than that behind the newest are dropped. The
    query's progress counts them (``stateOperators[0].numRowsDroppedByWatermark``).
    """
    window = F.window(event_time, size, slide)
    counted = s.withWatermark(event_time, delay).groupBy(window, *keys).agg(F.count("*").alias("postings"))
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "postings"
    )

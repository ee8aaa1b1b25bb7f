"""A corpus made ready for training: each stage takes what its predecessor kept.

``run`` reads ``documents`` and applies STAGES in order, each stage's rows written as Parquet
and read again. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillstrata.llm import bpe, line_templates, mixing, shingle_sets, simhash, suffix_quality
from skillstrata.llm.common import table, workers_find_package
from skillstrata.session import scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

ORACLE_SQL: str | None = None  # near duplicates and BPE have no form in SQL


def _set_aside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage run while extra columns of the input bear names of their own, so that none clashes with an operator's."""
    aside = {c: f"__extra_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang", "source", "n_chars")}
    back = [F.col(aside.get(c, c)).alias(c) for c in docs.columns]
    return stage(docs.withColumnsRenamed(aside)).select(back)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    NULL and empty texts have no words and go. Repeated rows are judged alike, very long texts
    whole. Extra columns of any name come through unchanged. An empty table gives an empty one.
    """
    workers_find_package(spark)
    return _set_aside(docs, lambda df: suffix_quality.quality(df).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less lines of recurring templates; those left without a word go.

    NULL and empty texts lose no line and stay. The smallest id keeps a template's lines; rows of
    one id are one document. Lines of any length are judged whole. Extra columns of any name come
    through unchanged. An empty table gives an empty one.
    """
    workers_find_package(spark)

    def stage(df: DataFrame) -> DataFrame:
        left = line_templates.drop_templates(df)
        touched = left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        return touched.where((F.col("n_dropped") == 0) | line_templates.has_words(F.col("text")))

    return _set_aside(docs, stage)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more.

    The row with the smallest id stays, NULL last; of repeated rows one. NULL texts and texts without
    words are one group. Extra columns of any name come through unchanged. An empty table gives an empty one.
    """
    workers_find_package(spark)
    return _set_aside(docs, lambda df: simhash.one_of_each(df, labelled=shingle_sets.labelled))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document as many times as the mix takes it, at most twice.

    NULL and empty texts have no words, so they take no share of a target; a NULL source is one of
    its own. Repeated rows are documents of their own. Extra columns of any name come through unchanged.
    An empty table gives an empty one.
    """
    workers_find_package(spark)
    return _set_aside(docs, lambda df: mixing.mixed(df, mixing.cycled_weights(df, (3.0, 1.0, 2.0)), share=1.5, most=2))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix; every row's ids are decoded and held against its text.

    NULL texts count as empty, and empty ones have no ids. Repeated rows are encoded alike, texts of
    any length whole. Extra columns are left out. An empty table gives an empty one.
    """
    workers_find_package(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256)
    decoded = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text", digest.alias("text_sha256")), path)
    return decoded.select(
        "doc_id", "lang", "source", "n_tokens", "ids", (F.sha2(F.encode("text", "utf-8"), 256) == F.col("text_sha256")).alias("decodes")
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_bpe", encode_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

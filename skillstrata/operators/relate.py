"""Joins between postings, their skills and their texts, and keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillstrata.session import scratch

MARKS = 1 << 26  # bits, 8 MB whatever the number of keys


def postings_with_skill(p: DataFrame, js: DataFrame) -> DataFrame:
    """One row for each posting and skill it asks for."""
    return p.join(js, "record_id")


def posting_with_text(p: DataFrame, text: DataFrame) -> DataFrame:
    """Postings with their text detail; a posting without text is kept."""
    return p.join(text, "record_id", "left")


def having_any_skill(p: DataFrame, js: DataFrame, skills: Sequence[str]) -> DataFrame:
    """Postings that ask for at least one of the skills."""
    return p.join(js.filter(F.col("skill").isin(list(skills))), "record_id", "left_semi")


def having_all_skills(p: DataFrame, js: DataFrame, skills: Sequence[str]) -> DataFrame:
    """Postings that ask for every one of the skills."""
    wanted = sorted(set(skills))
    holders = (
        js.filter(F.col("skill").isin(wanted))
        .groupBy("record_id")
        .agg(F.count_distinct("skill").alias("_held"))
        .filter(F.col("_held") == len(wanted))
    )
    return p.join(holders, "record_id", "left_semi")


def without_skill(p: DataFrame, js: DataFrame) -> DataFrame:
    """Postings with no recognised skill."""
    return p.join(js, "record_id", "left_anti")


def latest_by_key(df: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """The row with the highest version of each key; ties go to the highest row.

    An aggregate, so copies of a hot key are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in key and c != version]
    last = df.groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("_last"))
    return last.select(*[F.col(c) if c in key else F.col(f"_last.{c}") for c in df.columns])


def upsert(target: DataFrame, updates: DataFrame, key: Sequence[str], version: str | None = None) -> DataFrame:
    """``target`` with rows of ``updates`` put in: same key replaces, new key is added.

    Of a key's rows in ``updates`` the one with the highest ``version`` counts, without a
    version the highest row (see ``latest_by_key``). The result must go to another path than the one ``target`` is read from. NULL equals NULL in a key.
    """
    updates = latest_by_key(updates.withColumn("_version", F.col(version) if version else F.lit(0)), key, "_version").drop("_version")
    on: Column = F.lit(True)
    fresh = updates.select(*[F.col(k).alias(f"_new_{k}") for k in key])
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_new_{k}"))
    return target.join(fresh, on, "left_anti").unionByName(updates.select(*target.columns))


def key_marks(keys: DataFrame, col: str) -> DataFrame:
    """Stored pages of bits, one bit set for the hash of each key: at most 8 MB, so the planner can broadcast them."""
    path = scratch(keys.sparkSession, "marks")
    slots = keys.select(_slot(col).alias("_slot"))
    pages = slots.groupBy(F.bitmap_bucket_number("_slot").alias("_page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    pages.write.option("compression", "zstd").parquet(path)
    return keys.sparkSession.read.parquet(path)


def perhaps_marked(df: DataFrame, marks: DataFrame, col: str) -> DataFrame:
    """All rows whose key is among those of ``key_marks``, and of the others those that share a bit with one.

    Before an equi join with few keys it keeps most rows out of the shuffle; alone it decides nothing.
    """
    placed = df.withColumns({"_page": F.bitmap_bucket_number(_slot(col)), "_at": F.bitmap_bit_position(_slot(col)).cast("int")})
    byte = "cast(conv(hex(substring(_bits, _at div 8 + 1, 1)), 16, 10) as int)"
    return placed.join(marks, "_page").where(F.expr(f"shiftright({byte}, _at % 8) & 1 = 1")).select(df.columns)


def _slot(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(MARKS)) + 1

"""Cleaning of raw postings: one row in, one row out, except for the dedup.

All but ``dedup`` and ``dedup_audit`` are free of shuffles and windows, so they run unchanged
on a stream.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillstrata.dictionaries import CITY_SUFFIX, OTHER_ROLE, RoleRule
from skillstrata.functions import requirements, salary, text
from skillstrata.functions.requirements import EDUCATION_LEVELS, EducationLevel
from skillstrata.functions.skills import SkillAlias, match_by_join, skills_in
from skillstrata.session import scratch

FINGERPRINT_COLUMNS = ("raw_title", "raw_city", "company", "salary_text", "description", "posted_on")
LAST_PRIORITY = 1_000_000


def valid_rows(raw: DataFrame) -> DataFrame:
    """Postings with a title and a company."""
    return raw.filter(text.is_filled(F.col("raw_title")) & text.is_filled(F.col("company")))


def normalize_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Half-width, single-blank, lower-case form of the columns."""
    return df.withColumns({c: text.normalize(F.col(c)) for c in cols})


def standardize_role(df: DataFrame, rules: Sequence[RoleRule], other: str = OTHER_ROLE) -> DataFrame:
    """Adds ``role``: that of the first matching rule by priority, else ``other``."""
    role = F.lit(other)
    for rule in sorted(rules, key=lambda r: (r.priority, r.pattern), reverse=True):
        role = F.when(F.col("_title").rlike(rule.pattern), F.lit(rule.role)).otherwise(role)
    return df.withColumn("_title", text.normalize(F.col("raw_title"))).withColumn("role", role).drop("_title")


def standardize_city(df: DataFrame, aliases: DataFrame | None, suffix: str = CITY_SUFFIX) -> DataFrame:
    """Adds ``city``: the name an alias stands for, else the cleaned text itself.

    Of several names for one alias the first in the alphabet counts, so no posting is doubled.
    No join hint: the planner broadcasts the aliases where their size allows it.
    """
    bare = F.nullif(F.trim(F.regexp_replace(text.normalize(F.col("raw_city")), suffix, "")), F.lit(""))
    if aliases is None:
        return df.withColumn("city", bare)
    names = aliases.groupBy(F.col("alias").alias("_city_key")).agg(F.min("city").alias("_city_name"))
    return (
        df.withColumn("_city_key", bare)
        .join(names, "_city_key", "left")
        .withColumn("city", F.coalesce("_city_name", "_city_key"))
        .drop("_city_key", "_city_name")
    )


def parse_salary(df: DataFrame, days_per_month: float = salary.DAYS_PER_MONTH) -> DataFrame:
    """Adds ``salary_min``, ``salary_max`` (yuan a month) and ``salary_months``.

    All are NULL where the text does not follow the grammar; a reversed range is put in order.
    """
    fields = F.col("_fields")
    matched = F.size(fields) == salary.PARTS
    both = F.col("_low").isNotNull() & F.col("_high").isNotNull()
    return (
        df.withColumn("_fields", salary.parts(F.col("salary_text")))
        .withColumns(
            {
                "_low": F.when(matched, salary.monthly(fields, salary.LOW, days_per_month)),
                "_high": F.when(matched, salary.monthly(fields, salary.HIGH, days_per_month)),
                "_months": F.when(matched, salary.months_paid(fields)),
            }
        )
        .withColumns(
            {
                "salary_min": F.when(both, F.least("_low", "_high")),
                "salary_max": F.when(both, F.greatest("_low", "_high")),
                "salary_months": F.when(both, F.col("_months")),
            }
        )
        .drop("_fields", "_low", "_high", "_months")
    )


def extract_education(df: DataFrame, levels: Sequence[EducationLevel] = EDUCATION_LEVELS) -> DataFrame:
    """Adds ``education`` and ``education_rank``, NULL where no level is named."""

    def of_level(values: list) -> Column:
        # Without the guard, ANSI mode takes a NULL position for the last element.
        return F.when(F.col("_level").isNotNull(), F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_level")))

    return (
        df.withColumn("_wanted", text.normalize(F.col("req_text")))
        .withColumn("_level", requirements.education_level(F.col("_wanted"), levels))
        .withColumns({"education": of_level([x.name for x in levels]), "education_rank": of_level([x.rank for x in levels])})
        .drop("_wanted", "_level")
    )


def extract_experience(df: DataFrame) -> DataFrame:
    """Adds ``exp_min_years`` and ``exp_max_years``.

    No upper bound is a NULL maximum; both are NULL where nothing is said.
    """
    wanted = F.col("_wanted")
    graduate = requirements.names_any(wanted, requirements.GRADUATE)
    anyone = requirements.names_any(wanted, requirements.OPEN_TO_ALL)
    low, high, least, most = (F.col(c) for c in ("_low", "_high", "_least", "_most"))
    digits = F.col("_digits")
    return (
        df.withColumn("_wanted", text.normalize(F.col("req_text")))
        .withColumn("_digits", requirements.with_digits(wanted))
        .withColumns(
            {
                "_low": requirements.years(digits, requirements.SPAN, 1),
                "_high": requirements.years(digits, requirements.SPAN, 2),
                "_least": requirements.years(digits, requirements.AT_LEAST),
                "_most": requirements.years(digits, requirements.AT_MOST),
            }
        )
        .withColumns(
            {
                "exp_min_years": F.when(low.isNotNull(), F.least(low, high))
                .when(least.isNotNull(), least)
                .when(most.isNotNull() | graduate | anyone, F.lit(0)),
                "exp_max_years": F.when(low.isNotNull(), F.greatest(low, high))
                .when(least.isNull() & most.isNotNull(), most)
                .when(least.isNull() & graduate, F.lit(0)),
            }
        )
        .drop("_wanted", "_digits", "_low", "_high", "_least", "_most")
    )


def extract_skills(
    df: DataFrame, dictionary: Sequence[SkillAlias] | DataFrame, text_col: str = "description"
) -> DataFrame:
    """Adds ``skills``, sorted and distinct, empty where none is found.

    A list becomes part of the expression; a DataFrame of any size is joined. In a join each
    different text is matched once, whichever postings have it.
    """
    if not isinstance(dictionary, DataFrame):
        return df.withColumn("skills", skills_in(F.col(text_col), list(dictionary)))
    named = df.withColumn("_text_id", F.md5(text_col))
    texts = named.filter(F.col("_text_id").isNotNull()).groupBy("_text_id").agg(F.first(text_col).alias("_text"))
    found = match_by_join(texts, dictionary, "_text_id", "_text")
    skills = F.coalesce("skills", F.array().cast("array<string>"))
    return named.join(found, "_text_id", "left").withColumn("skills", skills).drop("_text_id")


def with_lineage(df: DataFrame, batch_id: str) -> DataFrame:
    """Adds ``batch_id``, and ``source_file`` where the reader has not set it."""
    out = df.withColumn("batch_id", F.lit(batch_id))
    return out if "source_file" in df.columns else out.withColumn("source_file", F.lit(None).cast("string"))


def with_fingerprint(df: DataFrame, cols: Sequence[str] = FINGERPRINT_COLUMNS) -> DataFrame:
    """Adds the content ``fingerprint``."""
    return df.withColumn("fingerprint", text.fingerprint(F.col(c) for c in cols))


def priority_of(source: Column, priority: Mapping[str, int]) -> Column:
    """Rank of a source; one that is not listed comes last."""
    rank = F.lit(LAST_PRIORITY)
    for name, place in priority.items():
        rank = F.when(source == name, F.lit(place)).otherwise(rank)
    return rank


def dedup(df: DataFrame, priority: Mapping[str, int] | None = None) -> DataFrame:
    """One row for each fingerprint: lowest source priority, then lowest record id, then source.

    Only what tells rows apart is grouped: fingerprints that occur more than once are found on
    narrow columns, each map task sending one row of a fingerprint however many copies there
    are, and the whole rows meet these alone. Of rows alike in all of that the first by the other
    columns stays; equal ones are one before the shuffle.
    """
    place = F.struct(priority_of(F.col("source"), priority or {}).alias("priority"), "record_id", "source")
    shared = (
        df.groupBy("fingerprint", "record_id", "source")
        .agg(F.count("*").alias("_same"))
        .groupBy("fingerprint")
        .agg(F.sum("_same").alias("_copies"), F.min(F.struct(place.alias("place"), F.col("_same").alias("alike"))).alias("_best"))
        .where("_copies > 1")
        .select("fingerprint", F.col("_best.place").alias("_place"), F.col("_best.alike").alias("_alike"))
    )
    # Stored, few as they are: the planner knows their size, and rows move once, not once for each of two branches.
    path = scratch(df.sparkSession, "shared")
    shared.write.parquet(path)
    shared = df.sparkSession.read.parquet(path)
    met = df.join(shared, "fingerprint", "left").where(F.col("_place").isNull() | F.col("_place").eqNullSafe(place))
    if shared.where("_alike > 1").isEmpty():
        return met.select(df.columns)
    others = [c for c in df.columns if c != "fingerprint"]
    alike = met.where("_alike > 1").groupBy("fingerprint").agg(F.array_min(F.collect_set(F.struct(*others))).alias("_row"))
    first = alike.select("fingerprint", "_row.*").select(df.columns)
    return met.where("_alike is null or _alike = 1").select(df.columns).unionByName(first)


def dedup_audit(raw: DataFrame, priority: Mapping[str, int] | None = None) -> DataFrame:
    """Rows before and after the dedup and rows removed, by source and for all (``source`` NULL)."""
    narrow = raw.select("source", "record_id", "fingerprint")
    before = narrow.select("source", F.lit(1).alias("_before"), F.lit(0).alias("_after"))
    after = dedup(narrow, priority).select("source", F.lit(0).alias("_before"), F.lit(1).alias("_after"))
    source = F.col("source")
    return (
        before.unionByName(after)
        .groupingSets([[source], []], source)
        .agg(F.sum("_before").alias("rows_before"), F.sum("_after").alias("rows_after"))
        .withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))
    )

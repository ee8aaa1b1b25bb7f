"""Data-quality tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillstrata.functions.text import is_filled


def _percent(part: str, whole: str) -> Column:
    return F.round(100 * F.col(part).cast("double") / F.col(whole), 1)


def quality_report(valid: DataFrame, p: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Rows before and after the dedup and coverage of skill, salary and description.

    One line for each source and one, with ``source`` NULL, for all. ``valid`` are the rows
    before the dedup, ``p`` the Silver postings; coverage is over the latter. ``raw``, the rows as they
    were read, adds ``files``, the number of files they came from.
    """
    nothing = F.lit(0)
    columns = ("_files", "_before", "_after", "_skill", "_salary", "_text")

    def part(df: DataFrame, **own: Column) -> DataFrame:
        return df.select("source", *[own.get(c, nothing).cast("long").alias(c) for c in columns])

    parts = [
        part(valid, _before=F.lit(1)),
        part(
            p,
            _after=F.lit(1),
            _skill=(F.size("skills") > 0).cast("int"),
            _salary=F.col("salary_min").isNotNull().cast("int"),
            _text=F.col("has_description").cast("int"),
        ),
    ]
    if raw is not None:
        parts.append(part(raw.where("source_file is not null").groupBy("source", "source_file").agg(F.count("*")), _files=F.lit(1)))
    source = F.col("source")
    counted = reduce(DataFrame.unionByName, parts).groupingSets([[source], []], source).agg(*[F.sum(c).alias(c) for c in columns])
    return counted.select(
        "source",
        *([] if raw is None else [F.col("_files").alias("files")]),
        F.col("_before").alias("rows_before"),
        F.col("_after").alias("rows_after"),
        (F.col("_before") - F.col("_after")).alias("rows_removed"),
        _percent("_skill", "_after").alias("skill_pct"),
        _percent("_salary", "_after").alias("salary_pct"),
        _percent("_text", "_after").alias("description_pct"),
    )


def run_summary(raw: DataFrame, valid: DataFrame, p: DataFrame) -> DataFrame:
    """The whole run in one row; with ``files`` where ``raw`` knows its ``source_file``."""
    total = quality_report(valid, p, raw if "source_file" in raw.columns else None).filter(F.col("source").isNull()).drop("source")
    collected = raw.agg(F.count("*").alias("n"))
    return total.select(collected.scalar().alias("rows_collected"), "*")


def completeness(df: DataFrame) -> DataFrame:
    """Nulls, blanks and distinct values of each column, one line for each column.

    Values are compared by md5, so the shuffle carries 16 bytes for a text of any length, and
    repeated values of a column are counted before it.
    """
    columns = df.columns
    cells = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.col(c).isNull().alias("_null"),
                        (F.col(c).isNotNull() & ~is_filled(F.col(c).cast("string"))).alias("_blank"),
                        F.unhex(F.md5(F.col(c).cast("string"))).alias("_digest"),
                    )
                    for c in columns
                ]
            )
        )
    )
    values = cells.groupBy("column_name", "_null", "_blank", "_digest").agg(F.count("*").alias("_rows"))
    return values.groupBy("column_name").agg(
        F.sum("_rows").alias("rows"),
        F.sum(F.when(F.col("_null"), F.col("_rows")).otherwise(0)).alias("nulls"),
        F.sum(F.when(F.col("_blank"), F.col("_rows")).otherwise(0)).alias("blanks"),
        F.count("_digest").alias("distinct_values"),
    )


SKETCH_BITS = 14  # 2**14 registers: a standard error of 0.8 %


def sketched(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Nulls, blanks and a mergeable sketch of the distinct values of each column, one line for a group and column.

    One row a task and group is shuffled, whatever the cells hold. Kept by month, say, the lines of
    a new month are added and ``completeness_of`` puts any months together.
    """
    columns = [c for c in df.columns if c not in by]

    def cell(c: str) -> Column:
        value = F.col(c).cast("string")
        return F.struct(
            F.lit(c).alias("column_name"),
            F.count("*").alias("total"),
            F.count_if(value.isNull()).alias("nulls"),
            F.count_if(value.isNotNull() & ~is_filled(value)).alias("blanks"),
            F.hll_sketch_agg(value, F.lit(SKETCH_BITS)).alias("sketch"),
        ).alias(c)

    # An aggregate in a struct: all columns in one pass, then a line for each.
    return df.groupBy(*by).agg(F.array(*map(cell, columns)).alias("_cells")).select(*by, F.inline("_cells"))


def completeness_of(lines: DataFrame) -> DataFrame:
    """``completeness`` out of lines of ``sketched``, with distinct values within some percent of their number."""
    merged = lines.groupBy("column_name").agg(
        F.sum("nulls").alias("nulls"), F.sum("blanks").alias("blanks"), F.hll_union_agg("sketch").alias("_sketch"), F.sum("total").alias("_total")
    )
    return merged.select("column_name", F.col("_total").alias("rows"), "nulls", "blanks", F.hll_sketch_estimate("_sketch").alias("distinct_values"))

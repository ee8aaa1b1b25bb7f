"""Monthly salary range out of posting text.

Grammar: ``LOW[unit]-HIGH unit[/period][·N薪]``, or one amount ``N元/period`` for both ends. Units
are 千, k, 万 and 元; where only HIGH has one it counts for both. Periods are 月, 年 and 天, a month
where none is given.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillstrata.functions.text import FIELD_SEPARATOR, normalize

UNIT = "千|k|万|元"
SALARY_PATTERN = rf"^(?:([0-9.]+)({UNIT})?-([0-9.]+)({UNIT})|([0-9.]+)(元)(?=/))(?:/(月|年|天))?(?:·([0-9]+)薪)?$"
# Groups of the pattern that make up each part; of two alternatives one is empty.
PART_GROUPS = ((1, 5), (2,), (3, 5), (4, 6), (7,), (8,))
LOW, LOW_UNIT, HIGH, HIGH_UNIT, PERIOD, MONTHS, PARTS = 0, 1, 2, 3, 4, 5, 6
UNIT_YUAN = {"千": 1_000, "k": 1_000, "万": 10_000, "元": 1}
DAYS_PER_MONTH = 21.75
MONTHS_PAID = 12


def parts(text: Column) -> Column:
    """Low and its unit, high and its unit, period and months; an array of another size where the grammar is not met.

    One pass rewrites a matching text with a separator that normalised text cannot hold.
    """
    clean = F.regexp_replace(normalize(text), " ", "")
    marked = FIELD_SEPARATOR.join("".join(f"${group}" for group in groups) for groups in PART_GROUPS)
    return F.split(F.regexp_replace(clean, SALARY_PATTERN, marked), FIELD_SEPARATOR, -1)


def monthly(fields: Column, which: int, days_per_month: float = DAYS_PER_MONTH) -> Column:
    """``LOW`` or ``HIGH`` of the parts in whole yuan a month, in exact decimal arithmetic."""
    yuan = fields[which].try_cast("decimal(18,6)")
    unit = fields[HIGH_UNIT]
    if which == LOW:
        unit = F.coalesce(F.nullif(fields[LOW_UNIT], F.lit("")), unit)
    factor = F.lit(None).cast("decimal(5,0)")
    for name, size in UNIT_YUAN.items():
        factor = F.when(unit == name, F.lit(size).cast("decimal(5,0)")).otherwise(factor)
    period = fields[PERIOD]
    per_month = (
        F.when(period.isin("月", ""), yuan * factor)
        .when(period == "年", yuan * factor / F.lit(12).cast("decimal(2,0)"))
        .when(period == "天", yuan * factor * F.lit(str(days_per_month)).cast("decimal(6,3)"))
    )
    return F.floor(per_month).cast("bigint")


def months_paid(fields: Column) -> Column:
    """Months paid in a year, twelve unless stated."""
    # Blank is made NULL first: try_cast meets a bad number with a costly exception.
    return F.coalesce(F.nullif(fields[MONTHS], F.lit("")).try_cast("int"), F.lit(MONTHS_PAID))

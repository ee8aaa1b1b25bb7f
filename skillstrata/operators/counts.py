"""Counts of postings by role, city, major and skill, from Silver or from a stored cube.

Answers ask ``counted`` for the groups they need and do not care where the counts come from.
The cube holds them for several groupings, by month and for all months; a router takes the
smallest grouping that holds the keys asked for and merges it upwards where it holds more.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("role", "city", "major", "skill")
# Groupings of the cube, from few groups to many. A posting counts once for each of its skills,
# so a grouping by skill cannot answer a question without one.
GROUPINGS = (
    (),
    ("role",),
    ("city",),
    ("major",),
    ("role", "city"),
    ("role", "major"),
    ("skill",),
    ("role", "skill"),
    ("city", "skill"),
    ("role", "city", "skill"),
    ("role", "major", "skill"),
)
ALL_MONTHS, NO_MONTH = 0, 1
PART = 1_000_000


def part_of(grouping: int, month: int) -> int:
    """Number of the part of the cube for a grouping and a month."""
    return grouping * PART + month


def grouping_for(keys: Sequence[str]) -> int:
    """The first grouping, and so the smallest, that answers for these keys."""
    for at, grouping in enumerate(GROUPINGS):
        if set(keys) <= set(grouping) and ("skill" in keys) == ("skill" in grouping):
            return at
    raise ValueError(f"the cube has no grouping for {tuple(keys)}")


@dataclass(frozen=True)
class Counts:
    """The stored cube: ``read`` gives the rows of some parts, ``companies`` and ``ranges`` what sums cannot tell."""

    read: Callable[[Sequence[int]], DataFrame]
    companies: DataFrame  # role, companies
    ranges: DataFrame  # role, salary_min, salary_max, n
    months: Sequence[int] | None = None  # of posting, as 202401, all if None

    def of(self, *keys: str) -> DataFrame:
        """``(keys, postings)``. No posting, no row, but for the total."""
        at = grouping_for(keys)
        stored = self.read([part_of(at, m) for m in ((ALL_MONTHS,) if self.months is None else self.months)])
        if self.months is None and set(GROUPINGS[at]) == set(keys):
            return stored.select(*keys, "postings")
        return stored.groupBy(*keys).agg(F.sum("postings").alias("postings"))


def counted(source: DataFrame | Counts, *keys: str) -> DataFrame:
    """``(keys, postings)`` from Silver's postings or the cube."""
    if isinstance(source, Counts):
        return source.of(*keys)
    if "skill" in keys:
        source = source.select(*[k for k in keys if k != "skill"], F.explode("skills").alias("skill"))
    return source.groupBy(*keys).agg(F.count("*").alias("postings"))


def counted_majors(source: DataFrame | Counts, mapping: DataFrame | None, *keys: str) -> DataFrame:
    """Counts by major and other keys, by way of ``mapping (posting_major, major)`` where given."""
    found = counted(source, "major", *keys).where("major is not null")
    if mapping is None:
        return found
    found = found.withColumnRenamed("major", "posting_major").join(mapping, "posting_major")
    return found.groupBy("major", *keys).agg(F.sum("postings").alias("postings"))


def cube(signed: DataFrame, wanted: Sequence[int] | None = None) -> DataFrame:
    """``(part, role, city, major, skill, postings)`` of signed postings ``(role, city, major, skills, posted_month, n)``.

    With ``wanted`` only these parts: a part over all months then asks for no cells by month.
    """
    month = F.coalesce("posted_month", F.lit(NO_MONTH))
    groupings = [g for at, g in enumerate(GROUPINGS) if wanted is None or at in {part // PART for part in wanted}]
    by_month = wanted is None or any(part % PART != ALL_MONTHS for part in wanted)
    rows = signed.select(*KEYS[:3], "skills", "n", (month if by_month else F.lit(ALL_MONTHS)).alias("month"))
    parts = []
    for with_skill in (False, True):
        sets = [g for g in groupings if ("skill" in g) == with_skill]
        if not sets:
            continue
        own = rows.withColumn("skill", F.explode("skills")) if with_skill else rows.withColumn("skill", F.lit(None).cast("string"))
        # Summed by all their keys first: groupings then add up cells, of which there are no more with more postings.
        used = [k for k in KEYS if any(k in g for g in sets)]
        cells = own.groupBy(*used, "month").agg(F.sum("n").alias("n"))
        cells = cells.select(*[F.col(k) if k in used else F.lit(None).cast("string").alias(k) for k in KEYS], "n", "month")
        if by_month:
            cells = cells.select(*KEYS, "n", F.explode(F.array(F.lit(ALL_MONTHS), "month")).alias("month"))
        named = {sum(1 << (len(KEYS) - KEYS.index(k)) for k in KEYS if k not in g): GROUPINGS.index(g) for g in sets}
        columns = [F.col(c) for c in (*KEYS, "month")]
        grouped = cells.groupingSets([[F.col(c) for c in (*g, "month")] for g in sets], *columns)
        found = grouped.agg(F.sum("n").alias("postings"), F.grouping_id().alias("id"))
        number = F.element_at(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]), F.col("id").cast("int"))
        parts.append(found.select((number * PART + F.col("month")).alias("part"), *KEYS, "postings"))
    found = reduce(DataFrame.unionByName, parts).where("postings <> 0")
    return found if wanted is None else found.where(F.col("part").isin(list(wanted)))

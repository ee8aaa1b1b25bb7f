"""Answers over Silver and Gold: lists, details, rankings, local graphs, search.

Counts come from Silver's postings or from the stored cube of counts: ``p`` may be either.

Where an operator takes a role, skill, city or major, leaving it out answers for all of them
in one job. Lists and answers for one are ordered by postings, highest first, then by name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillstrata.functions.ranking import top_per_group
from skillstrata.functions.text import normalize
from skillstrata.operators.counts import Counts, counted, counted_majors
from skillstrata.operators.graph import edge_counts, node_counts

TOP_N = 20
PAGE_SIZE = 20


def _by_count(*names: str) -> list[Column]:
    return [F.col("postings").desc(), *[F.col(n) for n in names]]


def _only(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows with the wanted values; rows without a value never answer a question."""
    for col, value in wanted.items():
        df = df.filter(F.col(col).isNotNull() if value is None else F.col(col) == value)
    return df


def _top(df: DataFrame, section: str, name: str, value: str, order: Sequence[Column], top_n: int) -> DataFrame:
    best = df.orderBy(*order).limit(top_n)
    return best.select(
        F.lit(section).alias("section"), F.col(name).alias("name"), F.col(value).cast("double").alias("value")
    )


def _best(found: DataFrame, one: bool, group: Sequence[str], order: Sequence[Column], top_n: int | None) -> DataFrame:
    """The first rows of each group or, in order, of the one group there is."""
    if not one:
        return top_per_group(found, group, order, top_n)
    return found.orderBy(*order) if top_n is None else found.orderBy(*order).limit(top_n)


def overview(
    nodes: Mapping[str, DataFrame], edges: Mapping[str, DataFrame], p: DataFrame | Counts, js: DataFrame | Counts, top_n: int = 10
) -> DataFrame:
    """Node and edge counts, hot roles and hot skills as ``(section, name, value)``."""
    parts = [
        counts.select(F.lit(section).alias("section"), F.col("kind").alias("name"), F.col("n").cast("double").alias("value"))
        for section, counts in (("nodes", node_counts(nodes)), ("edges", edge_counts(edges)))
    ]
    parts.append(_top(job_roles(p), "hot_roles", "role", "postings", _by_count("role"), top_n))
    parts.append(_top(skills(js), "hot_skills", "skill", "postings", _by_count("skill"), top_n))
    return reduce(DataFrame.unionByName, parts)


def job_roles(p: DataFrame | Counts) -> DataFrame:
    """Roles with their postings."""
    return counted(p, "role").orderBy(*_by_count("role"))


def _role_figures(p: DataFrame | Counts, role: str) -> DataFrame:
    """One row about a role. The cube tells it from counts of the role's own cities and salary ranges."""
    middle = ((F.col("salary_min") + F.col("salary_max")) / 2.0).cast("decimal(18,2)")
    if not isinstance(p, Counts):
        return _only(p, role=role).agg(
            F.count("*").cast("double").alias("postings"),
            F.count_distinct("company").cast("double").alias("companies"),
            F.count_distinct("city").cast("double").alias("cities"),
            F.min("salary_min").cast("double").alias("salary_min"),
            F.max("salary_max").cast("double").alias("salary_max"),
            (F.sum(middle).cast("double") / F.count("salary_min")).alias("salary_mean"),
        )
    if p.months is not None:
        raise ValueError("companies and salary ranges are kept for all months together")
    size = _only(p.of("role"), role=role).agg(F.coalesce(F.sum("postings"), F.lit(0)).cast("double").alias("postings"))
    companies = _only(p.companies, role=role).agg(F.coalesce(F.sum("companies"), F.lit(0)).cast("double").alias("companies"))
    cities = _only(p.of("role", "city"), role=role, city=None).agg(F.count("*").cast("double").alias("cities"))
    salaries = _only(p.ranges, role=role).agg(
        F.min("salary_min").cast("double").alias("salary_min"),
        F.max("salary_max").cast("double").alias("salary_max"),
        (F.sum((middle * F.col("n")).cast("decimal(28,2)")).cast("double") / F.sum("n")).alias("salary_mean"),
    )
    # Four frames of one row each, put side by side as scalars.
    one = size.select("postings", companies.scalar().alias("companies"), cities.scalar().alias("cities"))
    return one.select("*", *[salaries.select(c).scalar().alias(c) for c in salaries.columns])


def role_detail(p: DataFrame | Counts, role: str, top_n: int | None = None) -> DataFrame:
    """Size, salaries and skills of one role, all or the top ones, as ``(section, name, value)``."""
    figures = _role_figures(p, role)
    summary = figures.unpivot([], figures.columns, "name", "value").select(F.lit("summary").alias("section"), "*")
    top = role_skills(p, role, top_n).select(
        F.lit("skills").alias("section"), F.col("skill").alias("name"), F.col("postings").cast("double").alias("value")
    )
    return summary.unionByName(top)


def job_postings(
    p: DataFrame,
    role: str | None = None,
    city: str | None = None,
    skill: str | None = None,
    major: str | None = None,
    page: int = 1,
    page_size: int = PAGE_SIZE,
    after: tuple[str | None, str] | None = None,
) -> DataFrame:
    """One page of the postings that pass the filters, newest first, then by record id.

    ``after`` is the ``(posted_on, record_id)`` of the last row seen, with None for a posting
    without a date, which come last: the next page then costs the same however deep it is,
    where ``page`` sorts out all rows before it.
    """
    for col, value in (("role", role), ("city", city), ("major", major)):
        if value is not None:
            p = p.filter(F.col(col) == value)
    if skill is not None:
        p = p.filter(F.array_contains("skills", skill))
    if after is not None:
        day, record = F.lit(after[0]).cast("date"), F.lit(after[1])
        later = F.col("record_id") > record
        undated = F.col("posted_on").isNull()
        if after[0] is None:
            p = p.filter(undated & later)
        else:
            p = p.filter((F.col("posted_on") < day) | ((F.col("posted_on") == day) & later) | undated)
    rows = p.select("record_id", "title", "role", "city", "company", "major", "salary_min", "salary_max", "posted_on")
    ordered = rows.orderBy(F.col("posted_on").desc(), "record_id")
    skipped = 0 if after is not None else (page - 1) * page_size
    return ordered.offset(skipped).limit(page_size)


def job_posting(p: DataFrame, text: DataFrame, record_id: str) -> DataFrame:
    """One posting with its skills and text. The id is looked up in both tables before the join."""
    own = _only(p, record_id=record_id)
    return own.join(_only(text, record_id=record_id), "record_id", "left")


def skills(js: DataFrame | Counts) -> DataFrame:
    """Skills with their postings, from the posting-skill relation or the cube."""
    found = js.of("skill") if isinstance(js, Counts) else js.groupBy("skill").agg(F.count("*").alias("postings"))
    return found.orderBy(*_by_count("skill"))


def cities(p: DataFrame | Counts) -> DataFrame:
    """Cities with their postings."""
    return _only(counted(p, "city"), city=None).orderBy(*_by_count("city"))


def majors(p: DataFrame | Counts) -> DataFrame:
    """Majors with their postings."""
    return _only(counted(p, "major"), major=None).orderBy(*_by_count("major"))


def role_skills(p: DataFrame | Counts, role: str | None = None, top_n: int | None = TOP_N) -> DataFrame:
    """Top skills of each or one role."""
    found = _only(counted(p, "role", "skill"), role=role)
    return _best(found, role is not None, ["role"], _by_count("skill"), top_n)


def skill_roles(p: DataFrame | Counts, skill: str | None = None, top_n: int | None = None) -> DataFrame:
    """Roles that ask for each or one skill, all or those that ask most."""
    found = _only(counted(p, "skill", "role"), role=None, skill=skill)
    return _best(found, skill is not None, ["skill"], _by_count("role"), top_n)


def city_skills(p: DataFrame | Counts, city: str | None = None, top_n: int | None = TOP_N) -> DataFrame:
    """Top skills of each or one city."""
    found = _only(counted(p, "city", "skill"), city=city)
    return _best(found, city is not None, ["city"], _by_count("skill"), top_n)


def role_cities(p: DataFrame | Counts, role: str | None = None) -> DataFrame:
    """Cities of each or one role, with the share of the role's postings that have a city."""
    found = _only(counted(p, "role", "city"), role=role, city=None)
    totals = found.groupBy("role").agg(F.sum("postings").alias("_all"))
    shares = found.join(totals, "role").select(
        "role", "city", "postings", (F.col("postings").cast("double") / F.col("_all")).alias("share")
    )
    return _best(shares, role is not None, ["role"], _by_count("city"), None)


def role_city_skills(
    p: DataFrame | Counts, role: str | None = None, city: str | None = None, top_n: int | None = None
) -> DataFrame:
    """Skills of each or one pair of role and city, all or the top ones."""
    found = _only(counted(p, "role", "city", "skill"), role=role, city=city)
    return _best(found, role is not None and city is not None, ["role", "city"], _by_count("skill"), top_n)


def major_roles(p: DataFrame | Counts, major: str | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """Roles tied to each or one major."""
    found = _only(counted_majors(p, mapping, "role"), major=major, role=None)
    return _best(found, major is not None, ["major"], _by_count("role"), None)


def _edges(df: DataFrame, src_kind: str, src: str, rel: str, dst_kind: str, dst: str) -> DataFrame:
    return df.select(
        F.lit(src_kind).alias("src_kind"),
        F.col(src).alias("src"),
        F.lit(rel).alias("rel"),
        F.lit(dst_kind).alias("dst_kind"),
        F.col(dst).alias("dst"),
        F.col("postings").alias("weight"),
    )


def role_subgraph(p: DataFrame | Counts, role: str, top_n: int | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """Edges from a role to skills, cities and majors, all or the ``top_n`` strongest of each kind."""
    parts = [
        _edges(_only(counted(p, "role", "skill"), role=role), "JobRole", "role", "ROLE_REQUIRES_SKILL", "Skill", "skill"),
        _edges(_only(counted(p, "role", "city"), role=role, city=None), "JobRole", "role", "LOCATED_IN", "City", "city"),
        _edges(_only(counted_majors(p, mapping, "role"), role=role), "JobRole", "role", "RELATED_TO_MAJOR", "Major", "major"),
    ]
    every = reduce(DataFrame.unionByName, parts)
    return top_per_group(every, ["rel"], [F.col("weight").desc(), F.col("dst")], top_n)


def skill_graph(
    p: DataFrame | Counts, skill: str | None = None, top_n: int | None = None, mapping: DataFrame | None = None
) -> DataFrame:
    """Role-skill and major-role edges, all or the ``top_n`` strongest of each kind.

    With a skill, only its own role edges and the majors of postings that ask for it.
    """
    asked = _only(counted(p, "role", "skill"), role=None, skill=skill)
    if skill is None:
        taught = counted_majors(p, mapping, "role")
    else:
        taught = counted_majors(p, mapping, "role", "skill").where(F.col("skill") == skill).drop("skill")
    parts = [
        _edges(asked, "JobRole", "role", "ROLE_REQUIRES_SKILL", "Skill", "skill"),
        _edges(_only(taught, role=None), "Major", "major", "RELATED_TO_ROLE", "JobRole", "role"),
    ]
    every = reduce(DataFrame.unionByName, parts)
    return top_per_group(every, ["rel"], [F.col("weight").desc(), F.col("src"), F.col("dst")], top_n)


def search(nodes: Mapping[str, DataFrame], text: str, limit: int | None = None) -> DataFrame:
    """Nodes whose name holds the text: exact match first, then prefix, then anywhere.

    The text is normalised as names were. Blank text finds nothing.
    """
    wanted = F.nullif(normalize(F.lit(text)), F.lit(""))
    hits = []
    for kind, table in nodes.items():
        name = F.lower(F.trim("name"))
        match = F.when(name == wanted, 0).when(name.startswith(wanted), 1).when(name.contains(wanted), 2)
        found = table.select(F.lit(kind).alias("kind"), "id", "name", match.cast("bigint").alias("match"))
        hits.append(found.filter(F.col("match").isNotNull()))
    every = reduce(DataFrame.unionByName, hits).orderBy("match", "name", "kind", "id")
    return every if limit is None else every.limit(limit)

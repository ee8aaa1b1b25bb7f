"""Dictionaries the cleaning operators take as parameters, with small defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame

from skillstrata.functions.requirements import EDUCATION_LEVELS, EducationLevel
from skillstrata.functions.salary import DAYS_PER_MONTH
from skillstrata.functions.skills import PHRASE, TOKEN, SkillAlias

OTHER_ROLE = "其他"
CITY_SUFFIX = "(市|地区)$"


class RoleRule(NamedTuple):
    pattern: str
    role: str
    priority: int


# The eight standard roles. The patterns and their order are ours.
ROLE_RULES = (
    RoleRule("算法", "算法工程师", 10),
    RoleRule("机器学习|machine learning", "机器学习工程师", 20),
    RoleRule("大数据.*(开发|工程师)", "大数据开发工程师", 30),
    RoleRule("数据仓库|数仓", "数据仓库工程师", 40),
    RoleRule("数据开发|etl", "数据开发工程师", 50),
    RoleRule(r"\bbi\b|bi分析|商业智能", "BI 分析师", 60),
    RoleRule("数据分析|数据挖掘", "数据分析师", 70),
    RoleRule("python", "Python 开发工程师", 80),
)

SKILLS = (
    *(SkillAlias(name, name, TOKEN) for name in ("python", "java", "scala", "sql", "r", "c++", "c#", "go")),
    *(SkillAlias(name, name, TOKEN) for name in ("spark", "hadoop", "hive", "flink", "kafka", "hbase", "mysql")),
    *(SkillAlias(name, name, TOKEN) for name in ("linux", "docker", "tensorflow", "pytorch", "tableau", "excel")),
    SkillAlias("pyspark", "spark", TOKEN),
    SkillAlias("power bi", "power bi", PHRASE),
    SkillAlias("机器学习", "机器学习", PHRASE),
    SkillAlias("machine learning", "机器学习", PHRASE),
    SkillAlias("深度学习", "深度学习", PHRASE),
    SkillAlias("数据仓库", "数据仓库", PHRASE),
    SkillAlias("数仓", "数据仓库", PHRASE),
    SkillAlias("数据挖掘", "数据挖掘", PHRASE),
    SkillAlias("数据分析", "数据分析", PHRASE),
)


@dataclass(frozen=True)
class Dictionaries:
    """Everything the cleaning needs to know that is not in the data.

    ``skills`` may be a DataFrame ``(alias, skill, mode)`` of any size and ``city_aliases``
    a DataFrame ``(alias, city)``; aliases are given in normalised form.
    """

    role_rules: Sequence[RoleRule] = ROLE_RULES
    skills: Sequence[SkillAlias] | DataFrame = SKILLS
    city_aliases: DataFrame | None = None
    city_suffix: str = CITY_SUFFIX
    education_levels: Sequence[EducationLevel] = EDUCATION_LEVELS
    other_role: str = OTHER_ROLE
    days_per_month: float = DAYS_PER_MONTH
    source_priority: Mapping[str, int] = field(default_factory=dict)

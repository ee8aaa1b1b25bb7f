"""Education and experience out of requirement text.

Words are looked for with ``contains``, which works on the bytes of a value; the regular
expressions for years are tried only on texts that hold their fixed part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class EducationLevel(NamedTuple):
    words: Sequence[str]
    name: str
    rank: int


# Lowest level first: where a text names several, the lowest is the requirement.
EDUCATION_LEVELS = (
    EducationLevel(("学历不限", "不限学历"), "不限", 0),
    EducationLevel(("初中", "高中", "中专", "中技"), "中专/高中", 1),
    EducationLevel(("大专", "专科"), "大专", 2),
    EducationLevel(("本科", "学士"), "本科", 3),
    EducationLevel(("硕士", "研究生"), "硕士", 4),
    EducationLevel(("博士",), "博士", 5),
)


class YearsPattern(NamedTuple):
    pattern: str
    fixed_part: Sequence[str]


# A number of years has at most two digits, so that a span of calendar years is not one.
SPAN = YearsPattern(r"(?<![0-9])([0-9]{1,2})[-~至]([0-9]{1,2})年", ("-", "~", "至"))
AT_LEAST = YearsPattern(r"(?<![0-9])([0-9]{1,2})年(?:及)?以上", ("以上",))
AT_MOST = YearsPattern(r"(?<![0-9])([0-9]{1,2})年(?:及)?(?:以内|以下)", ("以内", "以下"))
GRADUATE = ("在校", "应届")
OPEN_TO_ALL = ("经验不限", "不限经验", "无经验", "无需经验")


def names_any(clean: Column, words: Sequence[str]) -> Column:
    return reduce(or_, [clean.contains(word) for word in words])


def education_level(clean: Column, levels: Sequence[EducationLevel] = EDUCATION_LEVELS) -> Column:
    """Position in ``levels``, from 1, of the first that normalised text names, else NULL."""
    at = F.lit(None).cast("int")
    for place in range(len(levels), 0, -1):
        at = F.when(names_any(clean, levels[place - 1].words), F.lit(place)).otherwise(at)
    return at


def with_digits(clean: Column) -> Column:
    """Numbers up to 99 that are written in characters, as digits: 三年 is 3年, 十五年 is 15年."""
    digits = F.translate(F.replace(clean, F.lit("两年"), F.lit("二年")), "一二三四五六七八九", "123456789")
    tens = F.regexp_replace(F.regexp_replace(digits, "([1-9])十([1-9])", "$1$2"), "([1-9])十", "$10")
    return F.regexp_replace(F.regexp_replace(tens, "十([1-9])", "1$1"), "十", "10")


def years(clean: Column, wanted: YearsPattern, group: int = 1) -> Column:
    """A number of years out of normalised text."""
    found = F.nullif(F.regexp_extract(clean, wanted.pattern, group), F.lit("")).try_cast("int")
    return F.when(names_any(clean, wanted.fixed_part), found)

"""Skill matching by dictionary.

Two kinds of alias. A *phrase* is found anywhere in the text, which suits scripts that set
no blanks between words; at each place the longest alias wins and its characters are used
up, so ``java`` is not found inside ``javascript``. A *token* must be a whole word, which
suits short names such as ``r``, ``c++`` or ``go``.

A dictionary given as a list goes into the expression itself: no shuffle, and the same code
runs on a stream. One given as a DataFrame, of any size, is met with an equi join
(``match_by_join``). Both give the same result. Of several skills for one alias and kind the
first in the alphabet counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillstrata.functions.text import normalize

PHRASE, TOKEN = "phrase", "token"
SKILL_SCHEMA = "alias string, skill string, mode string"

# A word: Latin letters and digits, with + and # anywhere and . only inside.
GRAM = 3
LETTER = r"[\p{IsLatin}0-9+#]"
WORD_PATTERN = rf"{LETTER}+(?:\.{LETTER}+)*"
WORD_START = rf"(?<!{LETTER})(?<!{LETTER}\.)"
WORD_END = rf"(?!\.?{LETTER})"


class SkillAlias(NamedTuple):
    alias: str
    skill: str
    mode: str = PHRASE


def _no_skills() -> Column:
    return F.array().cast("array<string>")


def _to_skill(hits: Column, aliases: Sequence[SkillAlias]) -> Column:
    skill_of: dict[str, str] = {}
    for a in aliases:
        skill_of[a.alias] = min(a.skill, skill_of.get(a.alias, a.skill))
    renamed = {alias: skill for alias, skill in skill_of.items() if alias != skill}
    if not renamed:
        return hits
    names = F.create_map(*[F.lit(x) for pair in renamed.items() for x in pair])
    return F.transform(F.array_distinct(hits), lambda hit: F.coalesce(F.try_element_at(names, hit), hit))


def longest_match_pattern(names: Iterable[str]) -> str:
    """Regular expression that matches the longest of the names at a place.

    Names with a common beginning share it, so the cost at a place goes with the letters that
    can come next and not with the size of the dictionary.
    """

    def branch(endings: Sequence[str]) -> str:
        options = []
        for letter, group in groupby((e for e in endings if e), key=lambda ending: ending[0]):
            options.append(re.escape(letter) + branch([e[1:] for e in group]))
        if not options:
            return ""
        longer = options[0] if len(options) == 1 and endings[0] else f"(?:{'|'.join(options)})"
        return longer if endings[0] else f"{longer}?"

    return branch(sorted(set(names)))


def phrases_in(clean: Column, aliases: Sequence[SkillAlias]) -> Column:
    """Phrase skills of normalised text, from one regular-expression pass over it."""
    pattern = longest_match_pattern(a.alias for a in aliases)
    return _to_skill(F.regexp_extract_all(clean, F.lit(f"(?:{pattern})"), F.lit(0)), aliases)


def tokens_in(clean: Column, aliases: Sequence[SkillAlias]) -> Column:
    """Token skills of normalised text, from one pass that looks at the edges of words."""
    pattern = longest_match_pattern(a.alias for a in aliases)
    return _to_skill(F.regexp_extract_all(clean, F.lit(f"{WORD_START}(?:{pattern}){WORD_END}"), F.lit(0)), aliases)


def words_in(clean: Column) -> Column:
    """Distinct words of normalised text."""
    return F.array_distinct(F.regexp_extract_all(clean, F.lit(WORD_PATTERN), F.lit(0)))


def skills_in(text: Column, aliases: Sequence[SkillAlias]) -> Column:
    """Sorted distinct skills of a text; empty where there are none or the text is NULL."""
    clean = normalize(text)
    by_mode = {mode: [a for a in aliases if a.mode == mode] for mode in (PHRASE, TOKEN)}
    found = [
        F.coalesce(matcher(clean, by_mode[mode]), _no_skills())
        for mode, matcher in ((PHRASE, phrases_in), (TOKEN, tokens_in))
        if by_mode[mode]
    ]
    return F.sort_array(F.array_distinct(F.concat(*found))) if found else _no_skills()


def file_aliases(dictionary: DataFrame) -> DataFrame:
    """``(gram, offset, pre, post, alias, mode, skill)``: each alias under its rarest gram of GRAM characters.

    Rare means shared by few other aliases, so no gram gathers many. ``pre`` and ``post`` are the
    alias's characters next to the gram, at most GRAM on each side. A shorter alias is its own gram.
    """
    aliases = dictionary.where(F.length("alias") > 0).groupBy("alias", "mode").agg(F.min("skill").alias("skill"))
    long = aliases.where(F.length("alias") >= GRAM)
    starts = F.sequence(F.lit(0), F.length("alias") - GRAM)
    cut = long.select("alias", "mode", F.explode(starts).alias("offset")).withColumn("gram", F.substr("alias", F.col("offset") + 1, F.lit(GRAM)))
    shared = cut.groupBy("gram").agg(F.count("*").alias("aliases"))
    best = cut.join(shared, "gram").groupBy("alias", "mode").agg(F.min(F.struct("aliases", "gram", "offset")).alias("best"))
    at = F.col("best.offset")
    filed = long.join(best, ["alias", "mode"]).select(
        "best.gram",
        at.alias("offset"),
        F.substr("alias", F.greatest(at - GRAM, F.lit(0)) + 1, F.least(at, F.lit(GRAM))).alias("pre"),
        F.substr("alias", at + GRAM + 1, F.lit(GRAM)).alias("post"),
        "alias",
        "mode",
        "skill",
    )
    none = F.lit("")
    short = aliases.where(F.length("alias") < GRAM).select(F.col("alias").alias("gram"), F.lit(0).alias("offset"), none.alias("pre"), none.alias("post"), "alias", "mode", "skill")
    return filed.unionByName(short)


def emit_grams(clean: DataFrame, key: str, heads: Sequence[str], short: Sequence[str]) -> DataFrame:
    """``(key, at, gram, before, after)``: a row for each place of a text whose gram begins with one of ``heads``,
    and one where a name of ``short`` stands, whatever lengths the aliases have.

    ``clean`` has the text's characters in ``_chars``, as a place in a string is found by counting from its beginning.
    """
    size = F.size("_chars")

    def places(length: int) -> Column:
        return F.when(size >= length, F.sequence(F.lit(1), size - (length - 1))).otherwise(F.array().cast("array<int>"))

    def part(at: Column, length: int) -> Column:
        return F.concat(*[F.get("_chars", at + (k - 1)) for k in range(length)])

    def row(at: Column, gram: Column, before: Column, after: Column) -> Column:
        return F.struct(at.alias("at"), gram.alias("gram"), before.alias("before"), after.alias("after"))

    def gram(at: Column) -> Column:
        before = F.array_join(F.slice("_chars", F.greatest(at - GRAM, F.lit(1)), F.least(at - 1, F.lit(GRAM))), "")
        return row(at, part(at, GRAM), before, F.array_join(F.slice("_chars", at + GRAM, F.lit(GRAM)), ""))

    def names_of(length: int) -> Column:
        own = [name for name in short if len(name) == length]
        held = F.filter(places(length), lambda at: part(at, length).isin(own))
        return F.transform(held, lambda at: row(at, part(at, length), F.lit(""), F.lit("")))

    found = [F.transform(F.filter(places(GRAM), lambda at: part(at, 2).isin(list(heads))), gram)] if heads else []
    found += map(names_of, sorted({len(name) for name in short}))
    return clean.select(key, F.explode(F.array(*found)).alias("_rows")).select(key, F.inline("_rows"))


def match_by_join(texts: DataFrame, dictionary: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, skills)`` for texts with at least one skill; ``key`` is unique.

    Texts emit their grams once and meet the aliases filed under them by an equi join. The few
    characters around a gram leave hardly any but true hits, which are gathered by text and verified in
    place: the whole alias, and edges of words for tokens. Then the longest-first rule is applied.
    """
    filed = file_aliases(dictionary)
    # Two letters that grams begin with, and aliases of one or two letters: bounded by the
    # alphabet, however large the dictionary is.
    bounds = filed.select(F.when(F.length("gram") < GRAM, F.col("gram")).otherwise(F.substring("gram", 1, 2)).alias("part"), (F.length("gram") < GRAM).alias("short"))
    known = bounds.distinct().collect()
    heads, short = [r.part for r in known if not r.short], [r.part for r in known if r.short]
    clean = texts.select(F.col(key), normalize(F.col(text)).alias("_clean")).where(F.length("_clean") > 0)
    clean = clean.select(key, F.split("_clean", "").alias("_chars"))
    if not known:
        return clean.select(key, _no_skills().alias("skills")).limit(0)
    met = emit_grams(clean, key, heads, short).join(filed, "gram")
    met = met.where(F.col("before").endswith(F.col("pre")) & F.col("after").startswith(F.col("post")))
    hit = F.struct((F.col("at") - F.col("offset")).alias("at"), (-F.length("alias")).alias("minus_size"), "alias", "skill", "mode")
    by_text = met.groupBy(key).agg(F.sort_array(F.collect_list(hit)).alias("_hits")).join(clean, key)

    def stands(hit: Column) -> Column:
        at, size = hit["at"], -hit["minus_size"]
        whole = F.array_join(F.slice("_chars", at, size), "") == hit["alias"]
        start = F.greatest(at - 2, F.lit(1))
        before, after = F.array_join(F.slice("_chars", start, at - start), ""), F.array_join(F.slice("_chars", at + size, F.lit(2)), "")
        inside_word = before.rlike(rf"{LETTER}\.?$") | after.rlike(rf"^\.?{LETTER}")
        return whole & ((hit["mode"] == PHRASE) | ~inside_word)

    start = F.struct(F.lit(0).alias("free"), _no_skills().alias("skills"))

    def take(state: Column, one: Column) -> Column:
        next_free = one["at"] - one["minus_size"]
        taken = F.struct(next_free.alias("free"), F.array_append(state["skills"], one["skill"]).alias("skills"))
        return F.when(one["at"] >= state["free"], taken).otherwise(state)

    def of(mode: str) -> Column:
        return F.aggregate(F.filter("_true", lambda hit: hit["mode"] == mode), start, take)["skills"]

    found = by_text.select(key, F.filter("_hits", stands).alias("_true"))
    skills = F.sort_array(F.array_distinct(F.concat(of(PHRASE), of(TOKEN))))
    return found.select(key, skills.alias("skills")).where(F.size("skills") > 0)

"""Cleaning operators on hand-made rows."""

from __future__ import annotations

import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from skillstrata.dictionaries import ROLE_RULES, Dictionaries
from skillstrata.functions.skills import PHRASE, SKILL_SCHEMA, TOKEN, SkillAlias, emit_grams, file_aliases
from skillstrata.operators import clean, quality
from skillstrata.plans import lake_build
from skillstrata.session import scratch

RAW_SCHEMA = (
    "record_id string, source string, raw_title string, raw_city string, company string, major string, "
    "salary_text string, req_text string, description string, posted_on date"
)


def raw(spark, *rows):
    """Raw postings; each row names only the columns that matter."""
    base = {
        "record_id": None,
        "source": "a",
        "raw_title": "数据分析师",
        "raw_city": "北京市",
        "company": "甲公司",
        "major": None,
        "salary_text": None,
        "req_text": None,
        "description": None,
        "posted_on": date(2024, 1, 1),
    }
    filled = [{**base, "record_id": f"r{i}", **row} for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c] for c in base) for r in filled], RAW_SCHEMA)


def column(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy("record_id").collect()]


def test_valid_rows_needs_title_and_company(spark):
    df = raw(spark, {}, {"raw_title": None}, {"raw_title": " \t　"}, {"company": ""}, {"company": " x"})
    assert column(clean.valid_rows(df), "record_id") == ["r0", "r4"]


def test_normalize_text(spark):
    df = raw(spark, {"raw_title": "　Ｐｙｔｈｏｎ \t\n 工程师 （ＡＩ） "}, {"raw_title": None}, {"raw_title": " a b  c\x01"})
    assert column(clean.normalize_text(df, ["raw_title"]), "raw_title") == ["python 工程师 (ai)", None, "a b c"]


@pytest.mark.parametrize(
    ("title", "role"),
    [
        ("大数据开发工程师", "大数据开发工程师"),
        ("数据开发工程师", "数据开发工程师"),
        ("高级算法工程师（机器学习）", "算法工程师"),
        ("Machine  Learning Engineer", "机器学习工程师"),
        ("BI分析师", "BI 分析师"),
        ("数据分析师", "数据分析师"),
        ("Ｐｙｔｈｏｎ开发", "Python 开发工程师"),
        ("数仓工程师", "数据仓库工程师"),
        ("前台", "其他"),
        (None, "其他"),
    ],
)
def test_standardize_role(spark, title, role):
    assert column(clean.standardize_role(raw(spark, {"raw_title": title}), ROLE_RULES), "role") == [role]


def test_standardize_city(spark):
    aliases = spark.createDataFrame([("北京", "北京"), ("魔都", "上海")], "alias string, city string")
    df = raw(spark, *[{"raw_city": c} for c in ("北京市", " 魔都 ", "成都市", None, " ", "市")])
    assert column(clean.standardize_city(df, aliases), "city") == ["北京", "上海", "成都", None, None, None]
    assert column(clean.standardize_city(df, None), "city") == ["北京", "魔都", "成都", None, None, None]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("8-12千/月", (8000, 12000, 12)),
        ("1-1.5万/月·15薪", (10000, 15000, 15)),
        ("12-24万/年", (10000, 20000, 12)),
        ("200-300元/天", (4350, 6525, 12)),
        ("30-20千/月", (20000, 30000, 12)),
        ("８－１２千／月", (8000, 12000, 12)),
        (" 8 - 12千/月 ", (8000, 12000, 12)),
        ("8千-1.2万/月", (8000, 12000, 12)),
        ("10k-15K/月", (10000, 15000, 12)),
        ("15-25k·14薪", (15000, 25000, 14)),
        ("1-1.5万·13薪", (10000, 15000, 13)),
        ("8-12千", (8000, 12000, 12)),
        ("6000-8000元", (6000, 8000, 12)),
        ("9千-8千/月", (8000, 9000, 12)),
        ("200元/天", (4350, 4350, 12)),
        ("9000元/月·13薪", (9000, 9000, 13)),
        ("200元", (None, None, None)),
        ("8-12", (None, None, None)),
        ("8千/月", (None, None, None)),
        ("面议", (None, None, None)),
        ("1.2.3-4千/月", (None, None, None)),
        (".-.千/月", (None, None, None)),
        ("a\u001fb\u001fc\u001fd\u001fe", (None, None, None)),
        ("", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_parse_salary(spark, text, expected):
    parsed = clean.parse_salary(raw(spark, {"salary_text": text}))
    assert column(parsed, "salary_min", "salary_max", "salary_months") == [expected]


@pytest.mark.parametrize(
    ("text", "education", "rank", "years"),
    [
        ("大专 经验不限", "大专", 2, (0, None)),
        ("本科及以上，3-5年经验", "本科", 3, (3, 5)),
        ("硕士 1年以上", "硕士", 4, (1, None)),
        ("学历不限 ５－１０年", "不限", 0, (5, 10)),
        ("硕士优先，本科亦可", "本科", 3, (None, None)),
        ("在校/应届 博士", "博士", 5, (0, 0)),
        ("3年以内", None, None, (0, 3)),
        ("三年以上", None, None, (3, None)),
        ("两年以上，本科", "本科", 3, (2, None)),
        ("三-五年", None, None, (3, 5)),
        ("十年以上", None, None, (10, None)),
        ("十五年以下", None, None, (0, 15)),
        ("二十年以上", None, None, (20, None)),
        ("10-5年", None, None, (5, 10)),
        ("", None, None, (None, None)),
        (None, None, None, (None, None)),
    ],
)
def test_requirements(spark, text, education, rank, years):
    df = clean.extract_experience(clean.extract_education(raw(spark, {"req_text": text})))
    assert column(df, "education", "education_rank", "exp_min_years", "exp_max_years") == [(education, rank, *years)]


ALIASES = [
    SkillAlias("java", "java", PHRASE),
    SkillAlias("javascript", "javascript", PHRASE),
    SkillAlias("机器学习", "机器学习", PHRASE),
    SkillAlias("学习", "学习", PHRASE),
    SkillAlias("machine learning", "机器学习", PHRASE),
    SkillAlias("c", "c", TOKEN),
    SkillAlias("c++", "c++", TOKEN),
    SkillAlias("c#", "c#", TOKEN),
    SkillAlias("r", "r", TOKEN),
    SkillAlias("node.js", "node", TOKEN),
    SkillAlias("js", "javascript", TOKEN),
]
TEXTS = [
    ("JavaScript 与 Java", ["java", "javascript"]),
    ("javascriptjava", ["java", "javascript"]),
    ("只要JavaScript", ["javascript"]),
    ("熟悉机器学习", ["机器学习"]),
    ("Ｍａｃｈｉｎｅ  Learning, 学习", ["学习", "机器学习"]),
    ("会C++和C#。", ["c#", "c++"]),
    ("c/c++/r", ["c", "c++", "r"]),
    ("c.r", []),
    ("r.", ["r"]),
    ("node.js", ["node"]),
    ("js、node.js", ["javascript", "node"]),
    ("rust carrier ér", []),
    ("", []),
    (None, []),
]


def test_extract_skills(spark):
    df = raw(spark, *[{"record_id": f"{i:02d}", "description": text} for i, (text, _) in enumerate(TEXTS)])
    assert column(clean.extract_skills(df, ALIASES), "skills") == [want for _, want in TEXTS]


def test_list_and_table_of_aliases_give_the_same_skills(spark):
    texts = ["Spring Boot, .NET und CI/CD", "T-SQL; t-sqlx springboot", "asp.net r, R&D c++17 c++", None, "", "node.js v2.r .net.x"]
    hard = [SkillAlias(a, a, TOKEN) for a in ("spring boot", "spring", ".net", "ci/cd", "t-sql", "r", "c++", "node.js")]
    twice = [SkillAlias("java", "b", PHRASE), SkillAlias("java", "a", PHRASE), SkillAlias("spring", "framework", TOKEN)]
    for aliases, given in ((ALIASES, [text for text, _ in TEXTS]), (hard + twice, texts)):
        df = raw(spark, *[{"record_id": "same id", "description": text} for text in given])
        by_list = clean.extract_skills(df, aliases).select("description", "skills").collect()
        by_table = clean.extract_skills(df, spark.createDataFrame(aliases, SKILL_SCHEMA)).select("description", "skills").collect()
        assert sorted(map(repr, by_list)) == sorted(map(repr, by_table)) and len(by_list) == len(given)


def test_fingerprint(spark):
    df = raw(
        spark,
        {"raw_title": "Ａ b", "company": "X"},
        {"raw_title": " a  B ", "company": "x"},
        {"raw_title": "a b", "company": None, "raw_city": "x"},
        {"raw_title": "a b", "company": "x", "raw_city": None},
    )
    prints = column(clean.with_fingerprint(df), "fingerprint")
    assert prints[0] == prints[1]
    assert len(set(prints)) == 3


def test_dedup_keeps_best_source_then_lowest_id(spark):
    df = raw(spark, {"source": "b"}, {"source": "a"}, {"source": "a"}, {"raw_title": "别的", "source": "z"}, {"source": "z"})
    marked = clean.with_fingerprint(df)
    assert column(clean.dedup(marked, {"a": 0, "b": 1}), "record_id") == ["r1", "r3"]
    assert column(clean.dedup(marked, {"b": 0}), "record_id") == ["r0", "r3"]
    assert clean.dedup(marked, {}).columns == marked.columns
    audit = {r.source: (r.rows_before, r.rows_after, r.rows_removed) for r in clean.dedup_audit(marked, {"a": 0}).collect()}
    assert audit == {"a": (2, 1, 1), "b": (1, 0, 1), "z": (2, 1, 1), None: (5, 2, 3)}


def test_dedup_of_a_hot_group_is_reduced_before_the_shuffle(spark):
    hot = spark.range(20_000).select(
        F.col("id").cast("string").alias("record_id"),
        F.lit("a").alias("source"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("fingerprint"),
    )
    kept = clean.dedup(hot)
    assert kept.count() == 20_000 - 6_667 + 1
    assert kept.filter("fingerprint = 'same'").first().record_id == "0"
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_refine_gives_the_silver_columns(spark):
    df = raw(spark, {"description": "Python, 机器学习", "salary_text": "8-12千/月", "req_text": "本科 3-5年"})
    row = lake_build.build_silver(lake_build.build_bronze(df, "b1"), Dictionaries()).first()
    assert tuple(row.asDict()) == lake_build.SILVER_COLUMNS
    assert (row.role, row.city, row.skills, row.posted_month) == ("数据分析师", "北京", ["python", "机器学习"], 202401)


@pytest.mark.parametrize(("text", "expected"), [("8.12-16.08千/月", (8120, 16080)), ("12-24万/年", (10000, 20000)), ("200-300元/天", (4350, 6525))])
def test_salaries_are_exact(spark, text, expected):
    parsed = clean.parse_salary(raw(spark, {"salary_text": text}))
    assert column(parsed, "salary_min", "salary_max") == [expected]


@pytest.mark.parametrize(("text", "expected"), [("2020-2024年毕业", (None, None)), ("3~5年经验", (3, 5)), ("3至5年", (3, 5)), ("10-15年", (10, 15))])
def test_calendar_years_are_no_experience(spark, text, expected):
    found = clean.extract_experience(raw(spark, {"req_text": text}))
    assert column(found, "exp_min_years", "exp_max_years") == [expected]


def test_a_repeated_city_alias_does_not_double_postings(spark):
    aliases = spark.createDataFrame([("sh", "Shanghai"), ("sh", "Shantou")], "alias string, city string")
    found = clean.standardize_city(raw(spark, {"raw_city": "SH"}), aliases)
    assert column(found, "city") == ["Shanghai"] or column(found, "city") == [("Shanghai",)]


def skills_by_force(text: str, skill_of: dict[tuple[str, str], str], longest: int) -> list[str]:
    """At each place the longest alias of a kind, tokens between edges of words alone."""
    letter = r"[A-Za-zÀ-ÖØ-öø-ÿ0-9+#]"
    found = set()
    for mode in (PHRASE, TOKEN):
        at = 0
        while at < len(text):
            for size in range(min(longest, len(text) - at), 0, -1):
                skill = skill_of.get((text[at : at + size], mode))
                inside = re.search(rf"{letter}\.?$", text[max(0, at - 2) : at]) or re.match(rf"\.?{letter}", text[at + size : at + size + 2])
                if skill and (mode == PHRASE or not inside):
                    found.add(skill)
                    at += size - 1
                    break
            at += 1
    return sorted(found)


def test_a_large_table_of_aliases_of_many_lengths(spark):
    """100,000 aliases of 1 to 24 characters: right skills, and at most 1.5 rows for a character of text."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz数据机器学习.+#") for _ in range(rng.randint(3, 8))).strip(".")
    names = {" ".join(w for w in (word() for _ in range(rng.randint(1, 3))) if w)[:24].strip() for _ in range(110_000)} | {"r", "q", "数据", "c#", "ab"}
    rows = [(name, f"s{k % 5000}", rng.choice([PHRASE, TOKEN])) for k, name in enumerate(sorted(n for n in names if n))][:100_000]
    known = [name for name, _, _ in rows]
    texts = ["".join(rng.choice([f"{rng.choice(known)} ", f"{word()} ", rng.choice(known), "、"]) for _ in range(rng.randint(0, 60))) for _ in range(50)]
    df = raw(spark, *[{"record_id": str(k), "description": text} for k, text in enumerate(texts)])
    path = scratch(spark, "aliases")
    spark.createDataFrame(rows, SKILL_SCHEMA).repartition(8).write.parquet(path)
    aliases = spark.read.parquet(path)
    got = {r.record_id: r.skills for r in clean.extract_skills(df, aliases).select("record_id", "skills").collect()}
    squeezed = {k: " ".join(text.split()) for k, text in enumerate(texts)}
    skill_of = {(name, mode): skill for name, skill, mode in rows}
    assert got == {str(k): skills_by_force(text, skill_of, 24) for k, text in squeezed.items()}
    filed = file_aliases(aliases)
    assert filed.count() == len(rows)
    heads = [r[0] for r in filed.where("length(gram) = 3").select(F.substring("gram", 1, 2)).distinct().collect()]
    short = [r[0] for r in filed.where("length(gram) < 3").select("gram").distinct().collect()]
    chars = spark.createDataFrame([(k, list(text)) for k, text in squeezed.items() if text], "id long, _chars array<string>")
    assert emit_grams(chars, "id", heads, short).count() <= 1.5 * sum(map(len, squeezed.values()))


def test_sketched_completeness_is_near_the_exact_one(spark):
    df = spark.range(30_000).select(
        (F.col("id") % 12).alias("month"),
        F.col("id").cast("string").alias("own"),
        (F.col("id") % 700).alias("some"),
        F.when(F.col("id") % 3 == 0, " ").when(F.col("id") % 3 == 1, "x").alias("sparse"),
    )
    exact = {r.column_name: r for r in quality.completeness(df.drop("month")).collect()}
    by_month = quality.sketched(df, ["month"])
    assert by_month.count() == 12 * 3
    for r in quality.completeness_of(by_month).collect():
        want = exact[r.column_name]
        assert (r.rows, r.nulls, r.blanks) == (want.rows, want.nulls, want.blanks)
        assert abs(r.distinct_values / want.distinct_values - 1) < 0.03
    plan = by_month._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan.split("Exchange")[1]

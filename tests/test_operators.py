"""Invariants and brute-force checks of the operators behind the queries."""

from __future__ import annotations

from collections import Counter
from datetime import date
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from harness.postings import lake as build_lake
from skillstrata.functions.ranking import dense_rank_desc, top_per_group
from skillstrata.operators import analytics, clean, gold, graph, quality, relate, serve, trends
from skillstrata.plans import lake_build, refresh
from skillstrata.session import scratch
from skillstrata.sources import files, lake, relational

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lk(spark):
    return build_lake(spark, SMALL)


def postings(spark, *rows):
    """``(record_id, role, city, major, skills, posted_on, salary_min, salary_max)``"""
    schema = (
        "record_id string, role string, city string, major string, skills array<string>, posted_on date, "
        "salary_min bigint, salary_max bigint"
    )
    return spark.createDataFrame(list(rows), schema).withColumns(
        {"company": F.lit("c"), "title": F.col("role"), "source": F.lit("a"), "has_description": F.lit(True)}
    )


@pytest.fixture(scope="module")
def tiny(spark):
    d = date
    return postings(
        spark,
        ("1", "x", "A", "m", ["a", "b"], d(2024, 1, 5), 1000, 3000),
        ("2", "x", "A", "m", ["a", "b", "c"], d(2024, 1, 9), 2000, 2000),
        ("3", "x", "B", "n", ["a"], d(2024, 4, 1), None, None),
        ("4", "y", "B", None, ["c"], d(2024, 2, 1), 5000, 7000),
        ("5", "y", None, "n", [], None, 9000, 9001),
    )


def test_quality_arithmetic(lk):
    valid = clean.valid_rows(lk.bronze)
    lines = {r.source: r for r in quality.quality_report(valid, lk.p).collect()}
    total = lines.pop(None)
    for field in ("rows_before", "rows_after", "rows_removed"):
        assert sum(r[field] for r in lines.values()) == total[field]
    assert total.rows_before == total.rows_after + total.rows_removed
    assert total.rows_after == lk.p.count()


def test_gold_arithmetic(lk):
    assert lk.gold("skill_freq").agg(F.sum("postings")).first()[0] == lk.js.count()
    assert lk.gold("role_demand").agg(F.sum("postings")).first()[0] == lk.p.count()
    assert lk.js.distinct().count() == lk.js.count()


def test_graph_is_whole(lk):
    nodes, edges = graph.build_nodes(lk.p, lk.js), graph.build_edges(lk.p, lk.js)
    assert graph.dangling_edges(nodes, edges).count() == 0
    assert edges["REQUIRES"].count() == lk.js.count()
    some = nodes | {"City": nodes["City"].limit(0)}
    assert graph.dangling_edges(some, edges).count() == edges["LOCATED_IN"].count()


def test_graph_loads_once(lk):
    nodes = graph.build_nodes(lk.p, lk.js)
    merged = graph.merge_graph(graph.merge_graph({}, nodes), nodes)
    assert {k: t.count() for k, t in merged.items()} == {k: t.count() for k, t in nodes.items()}


def test_majors_by_mapping(spark, tiny):
    mapping = spark.createDataFrame([("m", "M1"), ("m", "M2")], "posting_major string, major string")
    assert sorted(r.name for r in graph.nodes_major(tiny, mapping).collect()) == ["M1", "M2"]
    assert graph.rel_related_to_major(tiny, mapping).count() == 4
    assert graph.rel_related_to_major(tiny).count() == 4


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("b", 20), (None, 30), ("c", 40)], "k string, v int")
    want = {"a": 1, "b": 20, None: 30, "c": 40}
    once = relate.upsert(old, new, ["k"])
    assert {r.k: r.v for r in once.collect()} == want
    assert {r.k: r.v for r in relate.upsert(once, new, ["k"]).collect()} == want


def test_latest_by_key(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "q")], "k string, t int, v string")
    assert {(r.k, r.t, r.v) for r in relate.latest_by_key(rows, ["k"], "t").collect()} == {("a", 3, "y"), ("b", 1, "q")}


def test_skill_sets(tiny):
    js = gold.gold_job_skill(tiny)

    def ids(df):
        return sorted(r.record_id for r in df.collect())

    assert ids(relate.having_any_skill(tiny, js, ["b", "c"])) == ["1", "2", "4"]
    assert ids(relate.having_all_skills(tiny, js, ["b", "a", "a"])) == ["1", "2"]
    assert ids(relate.without_skill(tiny, js)) == ["5"]


def test_dense_rank(spark):
    values = [1, 1, 2, 3, 3, 7, 8, 9, 1000, 1000, 1023, 1024, 10**12]
    ranked = dense_rank_desc(spark.createDataFrame([(v,) for v in values], "n bigint"), "n", "rank").collect()
    order = {v: i + 1 for i, v in enumerate(sorted(set(values), reverse=True))}
    assert Counter((r.n, r["rank"]) for r in ranked) == Counter((v, order[v]) for v in values)


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    top = top_per_group(df, ["g"], [F.col("id").desc()], 2)
    assert sorted(r.id for r in top.collect()) == [994, 995, 996, 997, 998, 999]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[-1]


def test_city_salary(tiny):
    lines = {r.city: r for r in gold.gold_city_salary(tiny).collect()}
    assert (lines["A"].n, lines["A"].salary_min, lines["A"].salary_max) == (2, 1000, 3000)
    assert (lines["A"].mean_mid, lines["A"].median_mid) == (2000.0, 2000.0)
    assert lines[None].median_mid == 9000.5
    by_role = {(r.city, r.role): r.n for r in gold.gold_city_salary(tiny, ("city", "role")).collect()}
    assert by_role == {("A", "x"): 2, ("B", "y"): 1, (None, "y"): 1}


def test_completeness(spark):
    df = spark.createDataFrame([("a", 1), (" ", 1), (None, 2), ("a", None)], "t string, n int")
    lines = {r.column_name: (r.rows, r.nulls, r.blanks, r.distinct_values) for r in quality.completeness(df).collect()}
    assert lines == {"t": (4, 1, 1, 2), "n": (4, 1, 0, 2)}


def test_one_and_all_agree(lk):
    every = {(r.role, r.skill, r.postings) for r in serve.role_skills(lk.p, top_n=4).collect()}
    one = [(r.role, r.skill, r.postings) for r in serve.role_skills(lk.p, "urgent", 4).collect()]
    assert one == sorted((r for r in every if r[0] == "urgent"), key=lambda r: (-r[2], r[1])) and len(one) == 4
    every = {tuple(r) for r in serve.role_cities(lk.p).collect()}
    assert {tuple(r) for r in serve.role_cities(lk.p, "open").collect()} == {r for r in every if r[0] == "open"}
    every = {tuple(r) for r in serve.major_roles(lk.p).collect()}
    assert {tuple(r) for r in serve.major_roles(lk.p, "MACHINERY").collect()} == {r for r in every if r[0] == "MACHINERY"}
    pair = serve.role_city_skills(lk.p, "open", "NATION_3", 3).collect()
    assert all((r.role, r.city) == ("open", "NATION_3") for r in pair)


def test_pages_follow_each_other(lk):
    seen, after = [], None
    for page in range(1, 5):
        rows = serve.job_postings(lk.p, role="open", page=page, page_size=7).collect()
        assert rows == serve.job_postings(lk.p, role="open", page_size=7, after=after).collect()
        after = (str(rows[-1].posted_on), rows[-1].record_id)
        seen += rows
    assert len({r.record_id for r in seen}) == 28
    assert seen == sorted(seen, key=lambda r: (-r.posted_on.toordinal(), r.record_id))


def test_posting_lookup_prunes(lk):
    plan = serve.job_posting(lk.p, lk.text, "17")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(record_id,17)") == 2


def test_search_order(tiny):
    js = gold.gold_job_skill(tiny)
    found = [(r.kind, r.name, r.match) for r in serve.search(graph.build_nodes(tiny, js), " A ").collect()]
    assert found == [("City", "A", 0), ("Skill", "a", 0)]


def test_skill_graph_around_one_skill(tiny):
    edges = {(r.src, r.rel, r.dst, r.weight) for r in serve.skill_graph(tiny, "c").collect()}
    assert edges == {
        ("x", "ROLE_REQUIRES_SKILL", "c", 1),
        ("y", "ROLE_REQUIRES_SKILL", "c", 1),
        ("m", "RELATED_TO_ROLE", "x", 1),
    }


def test_role_trend_counts_empty_months(tiny):
    lines = [(r.role, r.month, r.postings, r.prior_postings, r.change) for r in trends.role_trend(tiny).orderBy("role", "month").collect()]
    assert lines == [
        ("x", "2024-01", 2, None, None),
        ("x", "2024-02", 0, 2, -2),
        ("x", "2024-03", 0, 0, 0),
        ("x", "2024-04", 1, 0, 1),
        ("y", "2024-02", 1, None, None),
    ]


def test_skill_trend_window_is_in_months(tiny):
    lines = {(r.skill, r.month): r.postings_3m for r in trends.skill_trend(tiny).collect()}
    assert lines[("a", "2024-01")] == 2 and lines[("a", "2024-04")] == 1 and lines[("c", "2024-02")] == 2
    assert lines[("a", "2024-02")] == 2


def test_cooccurrence_against_brute_force(lk):
    sets = [r.skills for r in lk.p.select("skills").collect()]
    pairs = Counter(pair for s in sets for pair in combinations(sorted(s), 2))
    alone = Counter(x for s in sets for x in s)
    got = {(r.skill_a, r.skill_b): r for r in analytics.skill_cooccurrence(lk.p).collect()}
    assert {k: r.postings for k, r in got.items()} == dict(pairs)
    for (a, b), n in pairs.items():
        assert got[a, b].jaccard == pytest.approx(n / (alone[a] + alone[b] - n))
        assert got[a, b].lift == pytest.approx(n * len(sets) / (alone[a] * alone[b]))
    frequent = analytics.skill_cooccurrence(lk.p, min_count=5)
    assert frequent.count() == sum(n >= 5 for n in pairs.values())


def test_pagerank_against_brute_force(lk):
    cooc = analytics.skill_cooccurrence(lk.p).collect()
    names = sorted({r.skill_a for r in cooc} | {r.skill_b for r in cooc})
    at = {n: i for i, n in enumerate(names)}
    weight = np.zeros((len(names), len(names)))
    for r in cooc:
        weight[at[r.skill_a], at[r.skill_b]] = weight[at[r.skill_b], at[r.skill_a]] = r.postings
    move = weight / weight.sum(axis=1, keepdims=True)
    rank = np.full(len(names), 1 / len(names))
    for _ in range(7):
        rank = 0.15 / len(names) + 0.85 * rank @ move
    got = {r.skill: r["rank"] for r in analytics.skill_pagerank(analytics.skill_cooccurrence(lk.p), 7, cut_every=3).collect()}
    assert got == pytest.approx({n: rank[i] for n, i in at.items()})
    assert sum(got.values()) == pytest.approx(1.0)


def test_role_similarity(tiny):
    (line,) = analytics.role_similarity(tiny).collect()
    assert (line.role_a, line.role_b, line.shared_skills) == ("x", "y", 1)
    assert line.jaccard == pytest.approx(1 / 3)
    assert line.cosine == pytest.approx(1 / np.sqrt(9 + 4 + 1))


def test_recommendation_leaves_out_known_skills(tiny):
    names = [r.skill for r in analytics.recommend_skills(tiny, "x", ["a"]).collect()]
    assert names == ["b", "c"]


def test_forecast_is_least_squares_with_zeros(tiny):
    counted = trends.monthly(tiny, "role")
    slope, base = np.polyfit(range(4), [2, 0, 0, 1], 1)
    got = [r.expected_postings for r in analytics.forecast(counted, "role", 2).filter("role = 'x'").orderBy("months_ahead").collect()]
    assert got == pytest.approx([max(0, base + slope * 4), max(0, base + slope * 5)])
    flat = analytics.forecast(counted.filter("role = 'y'"), "role", 1).first()
    assert flat.expected_postings == 1.0


def test_refresh_empties_months_that_lost_everything(spark, tiny):
    silver = tiny.withColumn("posted_month", F.year("posted_on") * 100 + F.month("posted_on"))
    root = scratch(spark, "refresh-test")
    refresh.write_parts(silver, root, "city_salary", refresh.salary_part)
    # January moves to March and the posting without a date is withdrawn.
    moved = silver.filter("posted_on IS NOT NULL").withColumn(
        "posted_month", F.when(F.col("posted_month") == 202401, 202403).otherwise(F.col("posted_month"))
    )
    gone = silver.filter("posted_month = 202401 OR posted_on IS NULL")
    batch = gone.unionByName(moved.filter("posted_month = 202403"))
    got = gold.salary_figures(refresh.refresh_gold(spark, root, "city_salary", batch, moved, refresh.salary_part))
    want = gold.gold_city_salary(moved)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_refresh_reads_touched_months_only(lk):
    plan = refresh.salary_part(lk.p.filter(refresh.in_months([199701])))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(posted_month" in plan


def test_layer_keeps_partitions_it_does_not_write(spark):
    root = scratch(spark, "layer-test")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    lake.write_layer(df, root, lake.SILVER, "t", ["k"])
    changed = df.filter("k = 'a'").withColumn("v", F.lit(9))
    lake.write_layer(changed, root, lake.SILVER, "t", ["k"], keep_partitions=True)
    assert {r.k: r.v for r in lake.read_layer(spark, root, lake.SILVER, "t").collect()} == {"a": 9, "b": 2}
    lake.write_layer(changed, root, lake.SILVER, "t", ["k"])
    assert {r.k: r.v for r in lake.read_layer(spark, root, lake.SILVER, "t").collect()} == {"a": 9}


def test_file_census(spark, lk):
    root = scratch(spark, "census")
    for n, source in ((2, "src_a"), (3, "src_b")):
        lk.bronze.filter(F.col("source") == source).select("record_id", "raw_title").repartition(n).write.mode(
            "overwrite"
        ).options(**files.CSV_OPTIONS).csv(f"{root}/{source}")
    raw = [files.read_source(spark, f"{root}/{s}/*.csv", s, "record_id string, raw_title string") for s in ("src_a", "src_b")]
    census = {r.source: (r["files"], r["rows"]) for r in files.file_census(raw[0].unionByName(raw[1])).collect()}
    rows = {r.source: r["count"] for r in lk.bronze.groupBy("source").count().collect()}
    assert census == {"src_a": (2, rows["src_a"]), "src_b": (3, rows["src_b"])}


def test_csv_keeps_text_whole(spark):
    df = spark.createDataFrame([(1, ' a"b\n,c '), (2, ""), (3, None), (4, "\\")], "id int, t string")
    path = scratch(spark, "csv-test")
    files.write_unified(df, path)
    assert {tuple(r) for r in files.read_unified(spark, path, df.schema).collect()} == {tuple(r) for r in df.collect()}


def test_fuse_fills_missing_columns(spark):
    a = spark.createDataFrame([("1", "x")], "id string, job string")
    b = spark.createDataFrame([("2", "y", "z")], "key string, title string, city string")
    fused = files.fuse_sources([(a, {"id": "record_id", "job": "title"}), (b, {"key": "record_id"})])
    assert {tuple(r) for r in fused.collect()} == {("1", "x", None), ("2", "y", "z")}


def test_jdbc(spark):
    url = "jdbc:derby:memory:unit;create=true"
    df = spark.range(100).select("id", (F.col("id") * 2).alias("twice"))
    assert not relational.write_jdbc(df, url, "t", skip=True)
    for _ in range(2):
        assert relational.write_jdbc(df, url, "t")
    back = relational.read_jdbc(spark, url, "t", split_on="id", bounds=(0, 100), connections=4)
    assert back.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_pages_after_a_row_reach_undated_postings(spark):
    rows = [(str(i), "r", "c", "m", ["s"], date(2024, 1, 1) if i < 3 else None, 1, 2) for i in range(6)]
    p, seen, last = postings(spark, *rows), [], None
    while page := serve.job_postings(p, page_size=2, after=last).collect():
        seen += [r.record_id for r in page]
        last = (page[-1].posted_on and str(page[-1].posted_on), page[-1].record_id)
    assert seen == [str(i) for i in range(6)]


def test_answers_hold_all_rows_unless_limited(spark):
    rows = [(str(i), f"role {i}", "c", "m", ["s"], date(2024, 1, 1), 1, 2) for i in range(60)]
    p = postings(spark, *rows)
    assert serve.skill_roles(p, "s").count() == 60 and serve.skill_roles(p, "s", 5).count() == 5
    assert serve.skill_graph(p, "s").count() == 120 and serve.skill_graph(p, "s", 3).count() == 6


def test_search_text_is_normalised(spark):
    nodes = {"Skill": spark.createDataFrame([("1", "python"), ("2", "java")], "id string, name string")}
    assert [r.id for r in serve.search(nodes, " Ｐython ").collect()] == ["1"]
    assert serve.search(nodes, "  ").count() == 0


def test_upsert_takes_one_row_of_a_repeated_key(spark):
    target = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    updates = spark.createDataFrame([("a", 2), ("a", 3), ("c", 1)], "k string, v int")
    assert sorted(map(tuple, relate.upsert(target, updates, ["k"], "v").collect())) == [("a", 3), ("b", 1), ("c", 1)]


def test_a_header_in_another_order_is_an_error(spark):
    path = scratch(spark, "swapped")
    spark.createDataFrame([("engineer", "1")], "job string, id string").write.option("header", True).csv(path)
    with pytest.raises(Exception, match="(?i)header"):
        files.read_source(spark, path, "a", "id string, job string").collect()
    assert files.read_source(spark, path, "a", "job string, id string").first().job == "engineer"


def test_a_second_batch_keeps_the_first(spark, lk):
    root, raw = scratch(spark, "batches"), lk.bronze.select(*lake_build.RAW_COLUMNS)
    half = F.pmod(F.xxhash64("record_id"), F.lit(2))
    for batch, rows in (("2024-05", raw.filter(half == 0)), ("2024-06", raw.filter(half == 1))):
        lake_build.build_lake(spark, rows, lk.dicts, root, batch)
    lake_build.write_bronze(spark, raw.filter(half == 1), root, "2024-06")
    bronze = lake_build.read_bronze(spark, root)
    assert {r.batch_id for r in bronze.select("batch_id").distinct().collect()} == {"2024-05", "2024-06"}
    assert bronze.count() == raw.count()
    ids = sorted(r.record_id for r in lake.read_layer(spark, root, lake.SILVER, "posting").collect())
    assert ids == sorted(r.record_id for r in lk.p.collect())
    assert ids == sorted(r.record_id for r in lake.read_layer(spark, root, lake.SILVER, "posting_text").collect())

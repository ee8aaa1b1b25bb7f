"""Lake and Gold kept by batches, against full rebuilds; what a batch reads and rewrites."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skillstrata.dictionaries import Dictionaries
from skillstrata.operators import analytics, clean, gold, serve
from skillstrata.operators.counts import ALL_MONTHS, GROUPINGS, counted, grouping_for, part_of
from skillstrata.operators.name_index import NameIndex
from skillstrata.plans import lake_build, maintain
from skillstrata.session import scratch
from skillstrata.sources import fingerprints
from skillstrata.sources.buckets import BucketTable

SILVER_SCHEMA = "record_id string, role string, city string, company string, major string, skills array<string>, salary_min bigint, salary_max bigint, posted_month int"
RAW = "record_id string, source string, raw_title string, raw_city string, company string, major string, salary_text string, req_text string, description string, posted_on date"
DICTS = Dictionaries(source_priority={"a": 0, "b": 1})


def as_rows(df) -> list[str]:
    return sorted(map(str, df.collect()))


def full_gold(p) -> dict:
    js = gold.gold_job_skill(p)
    return {"job_skill": js, "skill_freq": gold.gold_skill_freq(js, p), "city_salary": gold.gold_city_salary(p), "role_demand": gold.gold_role_demand(p)}


def some_postings(rng: random.Random, ids: list[int]) -> list[tuple]:
    rows = []
    for i in ids:
        low = rng.choice([None, 1000, 2000, 3000])
        skills = sorted(rng.sample(["a", "b", "c", "d", "e"], rng.randint(0, 3)))
        city, company = rng.choice([None, "x", "y", "z"]), rng.choice([None, "k", "l", "m", f"own{i}"])
        rows.append((str(i), rng.choice(["r", "s", "t"]), city, company, rng.choice(["m", "n", None]), skills, low, low and low + rng.randint(0, 3) * 500, rng.choice([None, 202401, 202402, 202405])))
    return rows


def test_gold_by_signed_changes_equals_a_full_build(spark):
    """Batches that add, change and withdraw postings at random, down to none and up again."""
    rng = random.Random(8)
    root, stored, next_id = scratch(spark, "maintain"), {}, 0
    for number, (n_gone, n_changed, n_new) in enumerate([(0, 0, 60), (20, 15, 25), (1000, 0, 0), (0, 0, 10)]):
        gone = rng.sample(sorted(stored), min(n_gone, len(stored)))
        changed = rng.sample(sorted(set(stored) - set(gone)), min(n_changed, len(stored) - len(gone)))
        went = [stored[k] for k in (*gone, *changed)]
        came = some_postings(rng, [int(k) for k in changed] + list(range(next_id, next_id + n_new)))
        next_id += n_new
        for k in gone:
            del stored[k]
        stored |= {r[0]: r for r in came}
        for _ in range(2 if number == 1 else 1):  # the same batch again changes nothing
            maintain.apply(spark, root, spark.createDataFrame(came, SILVER_SCHEMA), spark.createDataFrame(went, SILVER_SCHEMA), f"b{number}", n_buckets=2)
        want = full_gold(spark.createDataFrame(list(stored.values()), SILVER_SCHEMA))
        got = maintain.read_gold(spark, root, n_buckets=2)
        for name, df in want.items():
            assert as_rows(got[name].select(df.columns)) == as_rows(df), (number, name)
        silver, counts = spark.createDataFrame(list(stored.values()), SILVER_SCHEMA), maintain.read_counts(spark, root, n_buckets=2)
        for keys in GROUPINGS if number == 1 else GROUPINGS[-2:]:
            if keys or stored:
                assert as_rows(counts.of(*keys)) == as_rows(counted(silver, *keys)), (number, keys)
        spring = maintain.read_counts(spark, root, [202401, 202402], n_buckets=2)
        assert as_rows(spring.of("city", "skill")) == as_rows(counted(silver.where("posted_month in (202401, 202402)"), "city", "skill"))


def test_a_batch_rewrites_the_buckets_of_its_keys_alone(spark):
    root = scratch(spark, "touched")
    rows = [(str(i), f"role{i % 40}", f"city{i % 40}", "c", "m", ["s"], 1000, 2000, 202401 + i % 12) for i in range(400)]
    maintain.apply(spark, root, spark.createDataFrame(rows, SILVER_SCHEMA), None, "b0", n_buckets=16)
    before = {name: maintain.state(root, name, 16).current(spark) for name in maintain.STATE}
    maintain.apply(spark, root, spark.createDataFrame([("new", "role3", "city3", "c", "m", ["s"], 1000, 2500, 202403)], SILVER_SCHEMA), None, "b1", n_buckets=16)
    for name in maintain.STATE:
        after = maintain.state(root, name, 16).current(spark)
        # A company and a city of the role are two keys; the cube has a part for each grouping, for the month and for all.
        most = {"role_values": 2, "counts": 2 * len(GROUPINGS)}.get(name, 1)
        assert 1 <= sum(after[b] != v for b, v in before[name].items()) <= most, name
    assert len(before["counts"]) == 13 * len(GROUPINGS)
    table = maintain.state(root, "city_values", 16)
    (bucket,) = table.touched(spark.createDataFrame([("city3",)], "city string"))
    files = table.read(spark, [bucket]).inputFiles()
    assert files and all(f"bucket={bucket}/" in f for f in files)


def test_withdrawing_what_never_came_is_refused(spark):
    root = scratch(spark, "refused")
    one = spark.createDataFrame([("1", "r", "x", "k", "m", ["a"], 1000, 2000, 202401)], SILVER_SCHEMA)
    with pytest.raises(PySparkException, match="fewer than none"):
        maintain.apply(spark, root, one.limit(0), one, "b0", n_buckets=2)


def test_bucket_table_shows_whole_updates_only(spark):
    table = BucketTable(scratch(spark, "buckets"), spark.createDataFrame([], "k int, v string").schema, ("k",), 8)
    assert table.read(spark).count() == 0 and table.tag(spark) is None
    table.replace(spark, spark.createDataFrame([(i, "old") for i in range(50)], "k int, v string"), None, "one")
    one = spark.createDataFrame([(7, "new")], "k int, v string")
    buckets = table.touched(one)
    kept = table.read(spark, buckets).where("k <> 7")
    # A writer that breaks off before the pointer leaves what readers see as it was.
    one.withColumn("bucket", table.bucket_of()).write.partitionBy("bucket").parquet(f"{table.path}/data/version=broken")
    assert {r.v for r in table.read(spark).collect()} == {"old"}
    table.replace(spark, kept.unionByName(one), buckets, "two")
    assert {r.k: r.v for r in table.read(spark).collect()} == {i: "new" if i == 7 else "old" for i in range(50)}
    table.replace(spark, one.limit(0), table.touched(one), "three")
    gone = {r.k for r in table.read(spark).collect()}
    assert 7 not in gone and table.tag(spark) == "three" and table.touched(spark.createDataFrame([(k,) for k in range(50)], "k int"))


def raw_batch(spark, rng, n: int, source: str):
    rows = []
    for _ in range(n):
        k = rng.randrange(120)
        day = date(2024, 1, 1) + timedelta(days=7 * (k % 20))
        rows.append((f"{source}{rng.randrange(10**6)}", source, f"title {k}", "city", f"Company {k}", "m", "8-12千/月", "本科 3-5年", f"python sql {k}", day))
    return spark.createDataFrame(rows, RAW)


def test_lake_by_batches_equals_a_lake_built_at_once(spark):
    """Repeats within and across batches, a better source coming later, a batch run twice."""
    rng = random.Random(3)
    root, batches = scratch(spark, "batches"), []
    for number, source in enumerate(("b", "a", "other")):
        batches.append(raw_batch(spark, rng, 80, source).cache())
        changes = lake_build.add_batch(spark, batches[-1], DICTS, root, f"b{number}", n_buckets=8, gold_buckets=2)
        if number == 1:
            assert changes.where("sign = -1").count()
            lake_build.add_batch(spark, batches[-1], DICTS, root, f"b{number}", n_buckets=8, gold_buckets=2)
    bronze = lake_build.build_bronze(batches[0], "x")
    for batch in batches[1:]:
        bronze = bronze.unionByName(lake_build.build_bronze(batch, "x"))
    want = lake_build.build_silver(bronze, DICTS).cache()
    got = lake_build.silver_by_month(root, "posting").read(spark)
    assert as_rows(got) == as_rows(want.select(got.columns))
    text = lake_build.silver_by_month(root, "posting_text").read(spark).select(*lake_build.TEXT_COLUMNS)
    assert as_rows(text) == as_rows(lake_build.build_silver_text(bronze, DICTS))
    for name, df in full_gold(want).items():
        assert as_rows(maintain.read_gold(spark, root, 2)[name].select(df.columns)) == as_rows(df), name


def test_a_batch_meets_the_index_without_moving_it(spark):
    root = scratch(spark, "index")
    rows = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("fingerprint"), F.col("id").cast("string").alias("record_id"), F.lit("b").alias("source"))
    fingerprints.add(spark, root, rows, 16)
    batch = rows.where("cast(record_id as int) % 100 = 0").withColumn("source", F.when(F.col("record_id") < "1", "a").otherwise("b"))
    batch = batch.unionByName(spark.createDataFrame([("new", "n", "b")], batch.schema)).withColumn("description", F.lit("text"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = fingerprints.against_index(spark, root, batch, {"a": 0, "b": 1}, 16)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert {(r.record_id, r.replaces) for r in found.collect()} == {("0", True), ("n", False)}
    # The batch alone is dealt out.
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1


def test_dedup_groups_narrow_columns(spark):
    """Descriptions of rows that occur once, or whose copies differ in id, are in no aggregate before the join."""
    rows = [("1", "a", "f", "text one"), ("2", "a", "f", "text two"), ("3", "b", "g", None), ("3", "b", "g", "z"), ("3", "b", "g", "z"), ("4", None, "h", "t"), (None, "a", "h", "u"), (None, "a", "h", "u")]
    df = spark.createDataFrame(rows, "record_id string, source string, fingerprint string, description string")
    kept = {r.fingerprint: (r.record_id, r.source, r.description) for r in clean.dedup(df, {"a": 0, "b": 1}).collect()}
    assert kept == {"f": ("1", "a", "text one"), "g": ("3", "b", None), "h": (None, "a", "u")}
    assert clean.dedup(df).count() == 3
    plan = clean.dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "SortAggregate" in line and "description" in line]


def test_router_takes_the_smallest_grouping_and_no_silver(spark):
    assert GROUPINGS[grouping_for(("city",))] == ("city",) and GROUPINGS[grouping_for(("major", "skill"))] == ("role", "major", "skill")
    with pytest.raises(ValueError, match="no grouping"):
        grouping_for(("city", "major"))
    root = scratch(spark, "router")
    rows = some_postings(random.Random(2), list(range(80)))
    silver = spark.createDataFrame(rows, SILVER_SCHEMA)
    maintain.apply(spark, root, silver, None, "b0", n_buckets=2)
    counts = maintain.read_counts(spark, root, n_buckets=2)
    answers = {
        "job_roles": lambda p: serve.job_roles(p),
        "role_detail": lambda p: serve.role_detail(p, "r"),
        "cities": lambda p: serve.cities(p),
        "majors": lambda p: serve.majors(p),
        "role_skills": lambda p: serve.role_skills(p, top_n=2),
        "skill_roles": lambda p: serve.skill_roles(p, "a"),
        "city_skills": lambda p: serve.city_skills(p, "x"),
        "role_cities": lambda p: serve.role_cities(p),
        "role_city_skills": lambda p: serve.role_city_skills(p, "r", "x"),
        "major_roles": lambda p: serve.major_roles(p),
        "role_subgraph": lambda p: serve.role_subgraph(p, "s"),
        "skill_graph": lambda p: serve.skill_graph(p, "a"),
        "recommend_skills": lambda p: analytics.recommend_skills(p, "r", ["b"]),
    }
    for name, answer in answers.items():
        got = answer(counts)
        assert as_rows(got) == as_rows(answer(silver)), name
        assert all("/gold/state/" in f for f in got.inputFiles()), name
    files = serve.cities(counts).inputFiles()
    assert len(files) == 1 and f"bucket={part_of(GROUPINGS.index(('city',)), ALL_MONTHS)}/" in files[0]
    # A mapping of majors applies to counts as to postings.
    mapping = spark.createDataFrame([("m", "M"), ("n", "M"), ("n", "N")], "posting_major string, major string")
    assert as_rows(serve.major_roles(counts, None, mapping)) == as_rows(serve.major_roles(silver, None, mapping))


def test_name_index_answers_as_a_search_of_all_names(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcéß数据") for _ in range(rng.randint(1, 6)))
    names = [*(" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(150)), "a", "", "  Ab ", None, "AB", "same", "same"]
    kinds = {kind: spark.createDataFrame([(f"{kind}{i}", name) for i, name in enumerate(names[at::2])], "id string, name string") for at, kind in enumerate(("Skill", "City"))}
    index = NameIndex(scratch(spark, "names"), 16).build(kinds)
    for text in ("a", "abc", " Ａb ", "数据", "same", "c a", "zzz", "  ", "ccb"):
        want = [tuple(r) for r in serve.search(kinds, text).collect()]
        assert [tuple(r) for r in index.search(spark, text).collect()] == want, text
    assert [r.name for r in index.search(spark, "a", 2).collect()] == [r.name for r in serve.search(kinds, "a", 2).collect()]


def test_name_search_opens_one_list_and_the_buckets_of_its_hits(spark):
    rows = [(str(i), f"name {i} of a kind") for i in range(3000)] + [("x", "zebra quilt")]
    index = NameIndex(scratch(spark, "names"), 32).build({"Skill": spark.createDataFrame(rows, "id string, name string")})
    files = index.names(spark, "bra qu").inputFiles()
    (bucket,) = index.table("lists").touched(spark.createDataFrame([("bra",)], "gram string"))
    grams = ("bra", "ra ", "a q", " qu")
    lists = {index.table("lists").touched(spark.createDataFrame([(g,)], "gram string"))[0] for g in grams}
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1 and int(files[0].split("bucket=")[1].split("/")[0]) in lists
    assert bucket in lists
    hits = [f for f in index.search(spark, "bra qu").inputFiles() if "/nodes/" in f]
    assert len({f.split("bucket=")[1].split("/")[0] for f in hits}) == 1

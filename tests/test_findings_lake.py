"""Small tests of what a review found in the lake and its queries."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harness import postings
from skillstrata.operators.counts import ALL_MONTHS, GROUPINGS, PART, cube
from skillstrata.operators import relate
from skillstrata.plans import lake_build
from skillstrata.session import SHUFFLE_CLEANUP, scratch, shared_root, shuffles_dropped
from skillstrata.sources import files, graph_files, graph_store


def test_platform_delivers_two_files_whatever_its_rows(spark, monkeypatch):
    """A bound on the rows of a file, as files with line breaks need, once cut platforms of a large table into more."""
    monkeypatch.setattr(files.write_csv, "__defaults__", (50,))
    source = F.element_at(F.array(*map(F.lit, postings.SOURCES)), (F.col("id") % 3 + 1).cast("int"))
    raw = spark.range(900).select(*[F.col("id").cast("string").alias(c) for c in lake_build.RAW_COLUMNS[:1]], source.alias("source"))
    raw = raw.select("*", *[F.lit("x").alias(c) for c in lake_build.RAW_COLUMNS[2:-1]], F.current_date().alias("posted_on"))
    platforms = postings.write_platforms(raw, scratch(spark, "platforms"))
    rows = reduce(DataFrame.unionByName, [df.select("source", "source_file") for df, _ in postings.read_platforms(spark, platforms)])
    assert sorted(map(tuple, files.file_census(rows).collect())) == [(s, postings.FILES_PER_SOURCE, 300) for s in postings.SOURCES]


def test_query_builds_no_table_that_it_does_not_read(spark):
    """Nodes of cities come from Silver's postings alone; texts, Gold and counts were built for every query."""
    lk = postings.Lake(spark, "/root/testdata/sf0.001").build()
    assert lk.p.count() > 0
    assert lk.written == {"posting"}
    assert lk.counts.of("role").count() > 0
    assert lk.written == {"posting", "counts"}
    assert lk.text.count() == lk.p.count()
    assert lk.complete().written == {"posting", "posting_unique", "posting_text", "counts", "job_skill", "skill_freq", "city_salary", "role_demand"}


def test_cube_expands_cells_not_postings(spark):
    """Groupings add up cells that are summed before: copies of a posting cost one row of the expansion."""
    row = ("r", "c", "m", ["s", "t"], 202401, 1)
    signed = spark.createDataFrame([row] * 50 + [(None, "c", None, ["s"], None, -2)], "role string, city string, major string, skills array<string>, posted_month int, n bigint")
    found = {(r.part, r.role, r.city, r.major, r.skill): r.postings for r in cube(signed).collect()}
    assert found[GROUPINGS.index(("city",)) * PART + ALL_MONTHS, None, "c", None, None] == 48
    assert found[GROUPINGS.index(("skill",)) * PART + 202401, None, None, None, "s"] == 50
    plan = cube(signed)._jdf.queryExecution().optimizedPlan().toString()
    expansion = plan.index("Expand")
    assert "Aggregate" in plan[expansion:]


def test_answers_ask_for_no_files_and_for_their_own_part_of_the_cube(spark):
    """Each answer once waited for the platforms' two files a source and for all groupings by month."""
    lk = postings.Lake(spark, "/root/testdata/sf0.001").build()
    direct = sorted(map(tuple, lk.counts.of("role", "skill").collect()))
    assert not Path(f"{lk.root}/platforms").exists() and not Path(f"{lk.root}/bronze").exists()
    assert lk.cells == {GROUPINGS.index(("role", "skill")) * PART + ALL_MONTHS}
    read = postings.Lake(spark, "/root/testdata/sf0.001").build()
    assert read.bronze.count() > 0 and Path(f"{read.root}/platforms").exists()
    assert sorted(map(tuple, read.counts.of("role", "skill").collect())) == direct


def test_parts_of_the_cube_are_those_of_the_whole(spark):
    row = ("r", "c", "m", ["s", "t"], 202401, 1)
    signed = spark.createDataFrame([row] * 5 + [(None, "c", None, ["s"], None, 2)], "role string, city string, major string, skills array<string>, posted_month int, n bigint")
    whole = sorted(map(str, cube(signed).collect()))
    parts = [g * PART + m for g in range(len(GROUPINGS)) for m in (ALL_MONTHS, 1, 202401)]
    assert sorted(str(r) for part in parts for r in cube(signed, [part]).collect()) == whole
    assert sorted(map(str, cube(signed, parts).collect())) == whole


def versions(root: str) -> set[str]:
    return {str(path) for path in Path(root).glob("*/data/version=*/bucket=*")}


def test_graph_load_moves_rows_once_and_keeps_no_copy(spark):
    """A load once made its rows three times over, stored what differed and left every shuffle on the disks."""
    root, nodes = scratch(spark, "store"), "id string, name string, role string"
    first = {"N": spark.createDataFrame([(str(i), f"n{i}", None) for i in range(40)], nodes), "E": spark.createDataFrame([(str(i), "x") for i in range(40)], "src_id string, dst_id string")}
    left = set(Path(shared_root(spark)).glob("changed-*"))
    assert graph_store.load(spark, root, first, 4) == {"N": 4, "E": 4}
    once = versions(root)
    assert graph_store.load(spark, root, first, 4) == {"N": 0, "E": 0}
    # Part of the rows, and rows that come twice, are no change either.
    assert graph_store.load(spark, root, {k: t.limit(7) for k, t in first.items()}, 4) == {"N": 0, "E": 0}
    assert graph_store.load(spark, root, {k: t.unionByName(t) for k, t in first.items()}, 4) == {"N": 0, "E": 0}
    assert versions(root) == once and set(Path(shared_root(spark)).glob("changed-*")) == left
    # NULL moves from one column to the other: that is a change. Of two rows of a key the higher one counts.
    some = spark.createDataFrame([("3", None, "n3"), ("3", None, "a"), ("new", "n", "r")], nodes)
    table = graph_store.stored(root, "N", some.schema, 4)
    assert graph_store.load(spark, root, {"N": some}, 4) == {"N": len(table.touched(some))}
    want = {str(i): (f"n{i}", None) for i in range(40)} | {"3": (None, "n3"), "new": ("n", "r")}
    assert {r.id: (r.name, r.role) for r in table.read(spark).collect()} == want and table.read(spark).count() == 41
    plan = graph_store._merged(spark, table, some, [0, 1, 2, 3])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_graph_export_is_packed_and_comes_back_whole(spark):
    odd = spark.createDataFrame([("1", 'a "b"\nc,d'), ("2", " x "), ("3", None), ("4", "")], "id string, name string")
    paths = graph_files.export_graph({"N": odd}, scratch(spark, "export"))
    assert {p.suffix for p in Path(paths["N"]).glob("part-*")} == {".gz"}
    assert sorted(map(tuple, graph_files.read_graph(spark, paths, {"N": odd})["N"].collect())) == sorted(map(tuple, odd.collect()))


def test_shuffles_of_a_build_go_with_the_write_that_made_them(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    with shuffles_dropped(spark):
        with shuffles_dropped(spark):
            pass
        assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == before


def test_marks_keep_every_key_and_few_others(spark):
    df = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k string, id long"))
    keys = df.where("id % 50 = 0")
    kept = {r.id for r in relate.perhaps_marked(df, relate.key_marks(keys, "k"), "k").collect()}
    assert set(range(0, 20_000, 50)) <= kept and len(kept) < 450


def test_a_batch_puts_its_rows_among_the_stored_ones_in_one_shuffle(spark):
    """Stored rows once moved for an anti join, then again with the new ones for the write."""
    stored = spark.createDataFrame([("f1", 202401, "old"), ("f2", 202401, "old"), (None, 202402, "a"), (None, 202402, "b"), ("f3", None, "old")], "fingerprint string, posted_month int, v string")
    came = spark.createDataFrame([("f1", 202401, "new"), ("f3", None, "new"), ("f4", 202403, "new")], stored.schema)
    whole = lake_build.with_came(spark, stored, came)
    want = [("None", "a"), ("None", "b"), ("f1", "new"), ("f2", "old"), ("f3", "new"), ("f4", "new")]
    assert sorted((str(r.fingerprint), r.v) for r in whole.collect()) == want
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange ") == 1


def test_two_batches_ask_for_no_files_of_platforms(spark):
    lk = postings.Lake(spark, "/root/testdata/sf0.001").build()
    assert lk.raw.count() > 0
    assert not Path(f"{lk.root}/platforms").exists() and not Path(f"{lk.root}/bronze").exists()

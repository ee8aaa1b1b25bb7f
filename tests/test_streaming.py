"""Streams against the same rows in one batch."""

from __future__ import annotations

import pytest

from harness.postings import lake as build_lake
from skillstrata.operators.clean import valid_rows
from skillstrata.plans.lake_build import refine
from skillstrata.session import scratch
from skillstrata.streaming import postings as streams
from skillstrata.streaming import sinks

SMALL = "/root/testdata/sf0.001"
SCHEMA = "id bigint, k string, t timestamp, v bigint"


@pytest.fixture
def feed(spark):
    """Files read one to a micro-batch, so that state and replacement are put to use."""
    path = scratch(spark, "feed")

    def add(*rows):
        df = spark.createDataFrame(list(rows), "id bigint, k string, t string, v bigint")
        df.coalesce(1).selectExpr("id", "k", "cast(t as timestamp) t", "v").write.mode("append").parquet(path)

    def stream():
        return streams.posting_stream(spark, "parquet", {"path": path, "maxFilesPerTrigger": "1"}, SCHEMA)

    return add, stream


def test_json_lines(spark):
    path = scratch(spark, "json")
    lines = [('{"id": 1, "k": "a"}',), ("not json",)]
    spark.createDataFrame(lines, "value string").write.text(path)
    out = scratch(spark, "json-out")
    s = streams.posting_stream(spark, "text", {"path": path}, "id bigint, k string")
    sinks.sink_files(s, out, scratch(spark, "json-ck")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {(1, "a"), (None, None)}


def test_clean_stream_is_the_batch(spark):
    lk = build_lake(spark, SMALL)
    path = f"{lk.root}/bronze/posting"
    s = streams.posting_stream(spark, "parquet", {"path": path, "maxFilesPerTrigger": "1"}, lk.bronze.schema)
    out = scratch(spark, "clean")
    cleaned = streams.clean_stream(s, lk.dicts)
    sinks.sink_files(cleaned, out, scratch(spark, "clean-ck")).awaitTermination()
    want = refine(valid_rows(lk.bronze), lk.dicts)
    got = spark.read.schema(want.schema).parquet(out)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_dedup_stream_over_micro_batches(spark, feed):
    add, stream = feed
    for batch in range(3):
        add(*[(batch * 100 + i, f"k{i % 7}", f"2024-01-0{batch + 1} 00:00:00", 0) for i in range(50)])
    out = scratch(spark, "dedup")
    marked = stream().withColumnRenamed("k", "fingerprint")
    deduped = streams.dedup_stream(marked, "t", "30 days", row_id="id", salts=4)
    sinks.sink_files(deduped, out, scratch(spark, "dedup-ck")).awaitTermination()
    assert sorted(r.fingerprint for r in spark.read.parquet(out).collect()) == [f"k{i}" for i in range(7)]


def test_heat_stream_updates_windows(spark, feed):
    add, stream = feed
    add((1, "a", "2024-01-01 01:00:00", 0), (2, "a", "2024-01-01 02:00:00", 0))
    add((3, "a", "2024-01-01 23:00:00", 0), (4, "b", "2024-01-02 01:00:00", 0))
    heat = streams.heat_stream(stream(), "t", ["k"], "1 day", delay="2 days")
    path = scratch(spark, "heat")
    sinks.sink_upsert(heat, path, ["window_start", "k"], scratch(spark, "heat-ck"), mode="update").awaitTermination()
    assert spark.read.parquet(path).select("batch_id").distinct().count() >= 2
    got = {(r.k, r.window_start.day, r.postings) for r in sinks.read_upserted(spark, path, ["window_start", "k"]).collect()}
    assert got == {("a", 1, 3), ("b", 2, 1)}


def test_upsert_keeps_last_version_and_compacts(spark, feed):
    add, stream = feed
    add((1, "a", "2024-01-03 00:00:00", 10), (2, "b", "2024-01-01 00:00:00", 20), (3, "a", "2024-01-01 00:00:00", 11))
    add((4, "a", "2024-01-02 00:00:00", 12), (5, "b", "2024-01-05 00:00:00", 21))
    path, checkpoint = scratch(spark, "upsert"), scratch(spark, "upsert-ck")
    sinks.sink_upsert(stream(), path, ["k"], checkpoint, version="t").awaitTermination()

    def current(at):
        return {r.k: r.v for r in sinks.read_upserted(spark, at, ["k"], "t").collect()}

    assert current(path) == {"a": 10, "b": 21}
    small = scratch(spark, "compact")
    sinks.compact_upserted(spark, path, small, ["k"], "t")
    assert current(small) == {"a": 10, "b": 21}
    assert spark.read.parquet(small).count() == 2
    # A second run finds nothing new and changes nothing.
    sinks.sink_upsert(stream(), path, ["k"], checkpoint, version="t").awaitTermination()
    assert current(path) == {"a": 10, "b": 21}
    # A query with a new checkpoint counts its batches anew and keeps what is there.
    sinks.sink_upsert(stream().filter("k = 'b'"), path, ["k"], scratch(spark, "upsert-ck"), version="t").awaitTermination()
    assert current(path) == {"a": 10, "b": 21}


def test_streaming_clean_needs_no_aggregate(spark):
    lk = build_lake(spark, SMALL)
    s = streams.posting_stream(spark, "parquet", {"path": f"{lk.root}/bronze/posting"}, lk.bronze.schema)
    plan = streams.clean_stream(s, lk.dicts)._jdf.queryExecution().analyzed().toString()
    # One aggregate, over the table of city aliases, which is no stream.
    assert "Window" not in plan and plan.count("Aggregate [") == plan.count("min(city") == 1
    assert streams.clean_stream(s, lk.dicts).isStreaming

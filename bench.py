"""Times the build of the lake and the headline queries; prints one line of JSON.

BENCH_SF_DIR and BENCH_CPUS set the data and the cores. Build steps run once, queries
are the median of BENCH_RUNS warm runs, each fully computed into a no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from harness import catalog, postings
from skillstrata.operators import analytics, gold, graph, quality, relate, serve, trends
from skillstrata.operators.clean import dedup_audit, valid_rows
from skillstrata.plans import lake_build
from skillstrata.session import build_session
from skillstrata.sources import files

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def timed(action: Callable[[], object]) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        # Small data: let adaptive rebalancing cut files small enough to feed every core.
        spark__sql__adaptive__advisoryPartitionSizeInBytes="2m",
    )
    spark.sparkContext.setLogLevel("ERROR")
    lake = postings.Lake(spark, SF_DIR)
    drain(postings.table(spark, SF_DIR, "orders"))

    raw = files.with_posting_key(postings.posting_raw(spark, SF_DIR))

    def graph() -> object:
        lake.written.update(("posting_unique", "posting", "posting_text", *lake_build.GOLD_TABLES))
        return lake.graph

    seconds = {
        "build_bronze": timed(lambda: lake_build.write_bronze(spark, raw, lake.root, postings.BATCH_ID)),
        "build_silver": timed(lambda: lake_build.write_silver(spark, lake.root, lake.dicts)),
        "build_gold": timed(lambda: lake_build.write_gold(spark, lake.root)),
        "build_graph": timed(graph),
        "build_counts": timed(lambda: lake.counts),
    }
    counts = lake.counts
    p, js, bronze = lake.p, lake.js, lake.bronze
    headline: dict[str, Callable[[], DataFrame]] = {
        "dedup_audit": lambda: dedup_audit(valid_rows(bronze), lake.dicts.source_priority),
        "quality_report": lambda: quality.quality_report(valid_rows(bronze), p),
        "completeness": lambda: quality.completeness(bronze.select(*lake_build.RAW_COLUMNS)),
        "skill_freq": lambda: gold.gold_skill_freq(js, p),
        "city_salary": lambda: gold.gold_city_salary(p),
        "role_demand": lambda: gold.gold_role_demand(p),
        "postings_with_skill": lambda: relate.postings_with_skill(p, js),
        "having_all_skills": lambda: relate.having_all_skills(p, js, catalog.WANTED_SKILLS[:2]),
        "edge_counts": lambda: graph.edge_counts(lake.graph[1]),
        "role_skills": lambda: serve.role_skills(counts, top_n=20),
        "role_city_skills": lambda: serve.role_city_skills(counts, top_n=5),
        "job_postings": lambda: serve.job_postings(p, catalog.ROLE, None, catalog.SKILL, None),
        "role_subgraph": lambda: serve.role_subgraph(counts, catalog.ROLE),
        "search": lambda: lake.names.search(spark, catalog.SEARCH_TEXT),
        "role_trend": lambda: trends.role_trend(p),
        "skill_trend": lambda: trends.skill_trend(p),
        "skill_cooccurrence": lambda: analytics.skill_cooccurrence(p),
        "role_similarity": lambda: analytics.role_similarity(p),
        "demand_forecast": lambda: catalog.demand_forecast(lake),
        "extract_skills_token": lambda: catalog.extract_skills_token(spark, SF_DIR),
    }
    for name, build in headline.items():
        drain(build())
        seconds[name] = statistics.median(timed(lambda: drain(build())) for _ in range(RUNS))
    seconds = {name: round(value, 3) for name, value in seconds.items()}
    result = {
        "metric": "build_and_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(result))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()

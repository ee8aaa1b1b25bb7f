"""One query for each operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, TimestampNTZType, TimestampType

from harness.postings import BATCH_ID, GOLD_BUCKETS, SOURCES, Lake, lake, read_platforms, skill_aliases, table
from skillstrata.functions.skills import SKILL_SCHEMA, TOKEN, SkillAlias
from skillstrata.operators import analytics, clean, gold, graph, quality, relate, serve, trends
from skillstrata.plans import lake_build, maintain
from skillstrata.session import scratch
from skillstrata.sources import files, graph_files, graph_store, relational, warehouse
from skillstrata.sources import lake as layers
from skillstrata.streaming import postings as streams
from skillstrata.streaming import sinks

Query = Callable[[SparkSession, str], DataFrame]

ROLE, OTHER_CITY, CITY, SKILL, MAJOR = "priority", "NATION_7", "NATION_3", "rod", "MACHINERY"
WANTED_SKILLS = ["rod", "bolt", "blue gizmo"]
KNOWN_SKILLS = ["rod", "red plate"]
SEARCH_TEXT = "an"
RECORD_ID = "src_c:998"
MIN_SUPPORT, MIN_CONFIDENCE = 0.004, 0.05
PAGERANK_STEPS = 6
TEST_BUCKETS = 64  # of the fingerprint index

# Words common in the documents; the first of a pair stands for the second.
TOKENS = ("the", "and", "that", "que", "les", "der", "und", "los", "with", "en")
HARD_TOKENS = ("apache license", "cc by-nc", "4.0", "and/or")
TOKEN_ALIASES = (("le", "les"), ("la", "les"))

EVENT_SCHEMA = "event_id bigint, ts string, user_id bigint, event_type string, value double, props string"


# Whole numbers that may be NULL, by query: compared as DOUBLE, since data frames outside
# Spark have no one form for them.
SALARIES = ("salary_min", "salary_max")
REQUIREMENTS = ("education_rank", "exp_min_years", "exp_max_years")
NULLABLE_NUMBERS = {
    "parse_salary": (*SALARIES, "salary_months"),
    "extract_education": ("education_rank",),
    "extract_experience": ("exp_min_years", "exp_max_years"),
    "upsert": SALARIES,
    "silver_posting": (*SALARIES, *REQUIREMENTS),
    "silver_two_batches": (*SALARIES, *REQUIREMENTS),
    "stream_clean": (*SALARIES, *REQUIREMENTS),
    "job_postings": SALARIES,
    "job_posting_detail": (*SALARIES, *REQUIREMENTS),
    "role_trend": ("prior_postings", "change"),
}


def as_double(query: Query, columns: tuple[str, ...]) -> Query:
    """The query with some columns as DOUBLE."""
    return lambda spark, sf_dir: query(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in columns})


def plain(df: DataFrame) -> DataFrame:
    """Dates and lists as text, the form both engines print alike."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ArrayType):
            c = F.array_join(c, ",")
        elif isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def on_lake(build: Callable[[Lake], DataFrame]) -> Query:
    return lambda spark, sf_dir: plain(build(lake(spark, sf_dir)))


# --- sources and sinks ---------------------------------------------------------------


def _read_platforms(lk: Lake) -> list[tuple[DataFrame, dict[str, str]]]:
    return read_platforms(lk.spark, lk.files)


def read_source(lk: Lake) -> DataFrame:
    parts = [
        df.withColumnsRenamed(names).select("source", *[c for c in lake_build.RAW_COLUMNS if c != "source"])
        for df, names in _read_platforms(lk)
    ]
    return reduce(DataFrame.unionByName, parts)


def fuse_sources(lk: Lake) -> DataFrame:
    return files.fuse_sources(_read_platforms(lk), keyed=True).select(*lake_build.RAW_COLUMNS)


def file_census(lk: Lake) -> DataFrame:
    """Files and rows of each platform, every one written as ``FILES_PER_SOURCE`` files."""
    return plain(files.file_census(reduce(DataFrame.unionByName, [df.select("source", "source_file") for df, _ in _read_platforms(lk)])))


def unified_csv_roundtrip(lk: Lake) -> DataFrame:
    raw = lk.bronze.select(*lake_build.RAW_COLUMNS)
    path = scratch(lk.spark, "unified")
    files.write_unified(raw, path)
    return files.read_unified(lk.spark, path, raw.schema)


def layer_roundtrip(lk: Lake) -> DataFrame:
    root = scratch(lk.spark, "layer")
    raw = lk.bronze.select(*lake_build.RAW_COLUMNS)
    layers.write_layer(raw, root, layers.BRONZE, "posting", ["source"], ["record_id"])
    return layers.read_layer(lk.spark, root, layers.BRONZE, "posting").select(*lake_build.RAW_COLUMNS)


def _warehouse(lk: Lake) -> str:
    db = "job_skill_" + lk.root.rsplit("-", 1)[-1]
    if not lk.spark.catalog.databaseExists(db):
        warehouse.register_warehouse(lk.spark, lk.complete().root, db)
        warehouse.warehouse_views(lk.spark, db)
    return db


def warehouse_roundtrip(lk: Lake) -> DataFrame:
    return lk.spark.sql(
        f"""SELECT posted_month, source, count(*) AS postings, count(salary_min) AS with_salary
        FROM {_warehouse(lk)}.dwd_posting GROUP BY posted_month, source"""
    )


def warehouse_views(lk: Lake) -> DataFrame:
    return lk.spark.table(f"{_warehouse(lk)}.ads_role_report")


def jdbc_roundtrip(lk: Lake) -> DataFrame:
    """All Gold tables through the database, as ``(table_name, name, postings)``."""
    default = f"jdbc:derby:memory:{scratch(lk.spark, 'gold').rsplit('/', 1)[-1]};create=true"
    url = lk.spark.conf.get("spark.skillstrata.jdbcUrl", default)
    names = {"job_skill": ["record_id", "skill"], "skill_freq": ["skill"], "city_salary": ["city"], "role_demand": ["role"]}
    counts = {"job_skill": F.lit(1), "skill_freq": F.col("postings"), "city_salary": F.col("n"), "role_demand": F.col("postings")}
    parts = []
    for name, keys in names.items():
        relational.write_jdbc(lk.gold(name), url, name, shard_by=keys)
        back = relational.read_jdbc(lk.spark, url, name, split_on=relational.SHARD)
        parts.append(
            back.select(
                F.lit(name).alias("table_name"),
                F.concat_ws(":", *keys).alias("name"),
                counts[name].cast("bigint").alias("postings"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _graph_rows(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> DataFrame:
    """Every attribute of nodes and edges in one frame."""
    wanted = {"role": "string", "city": "string", "posted_on": "string", "postings": "double"}

    def rows(kind: str, t: DataFrame, src: str, dst: str) -> DataFrame:
        rest = [(F.col(c) if c in t.columns else F.lit(None)).cast(form).alias(c) for c, form in wanted.items()]
        return t.select(F.lit(kind).alias("kind"), F.col(src).alias("src_id"), F.col(dst).alias("dst_id"), *rest)

    parts = [rows(kind, t, "id", "name") for kind, t in nodes.items()] + [rows(kind, t, "src_id", "dst_id") for kind, t in edges.items()]
    return reduce(DataFrame.unionByName, parts)


def graph_export_roundtrip(lk: Lake) -> DataFrame:
    nodes, edges = lk.graph
    named = {graph.NODE_TABLES[k]: t for k, t in nodes.items()} | {graph.EDGE_TABLES[k]: t for k, t in edges.items()}
    paths = graph_files.export_graph(named, scratch(lk.spark, "graph"))
    back = graph_files.read_graph(lk.spark, paths, named)
    return _graph_rows(
        {k: back[t] for k, t in graph.NODE_TABLES.items()}, {k: back[t] for k, t in graph.EDGE_TABLES.items()}
    )


def graph_merge(lk: Lake) -> DataFrame:
    """The exported graph loaded twice into a stored one that holds the first platform's part.

    ``second_load`` is how many buckets the second load rewrote.
    """
    first, root = lk.p.filter(F.col("source") == SOURCES[0]), scratch(lk.spark, "graph-store")
    js = gold.gold_job_skill(first)
    graph_store.load(lk.spark, root, graph.build_nodes(first, js) | graph.build_edges(first, js), GOLD_BUCKETS)
    nodes, edges = lk.graph
    paths = graph_files.export_graph(nodes | edges, scratch(lk.spark, "graph"))
    back = graph_files.read_graph(lk.spark, paths, nodes | edges)
    rewritten = [sum(graph_store.load(lk.spark, root, back, GOLD_BUCKETS).values()) for _ in range(2)]
    held = {kind: graph_store.stored(root, kind, t.schema, GOLD_BUCKETS).read(lk.spark) for kind, t in back.items()}
    rows = _graph_rows({k: held[k] for k in nodes}, {k: held[k] for k in edges})
    return rows.withColumn("second_load", F.lit(rewritten[1]).cast("long"))


def dangling_edges(lk: Lake) -> DataFrame:
    """All edges held against the nodes of the first platform alone."""
    first = lk.p.filter(F.col("source") == SOURCES[0])
    return graph.dangling_edges(graph.build_nodes(first, gold.gold_job_skill(first)), lk.graph[1])


def run_summary(lk: Lake) -> DataFrame:
    summary = quality.run_summary(lk.bronze, clean.valid_rows(lk.bronze), lk.p)
    path = scratch(lk.spark, "summary")
    files.write_summary(summary, path)
    return lk.spark.read.schema(summary.schema).json(path)


# --- cleaning ------------------------------------------------------------------------


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.normalize_text(table(spark, sf_dir, "documents"), ["text", "source"]).select("doc_id", "text", "source")


def extract_skills_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = [SkillAlias(word, word, TOKEN) for word in TOKENS] + [SkillAlias(a, s, TOKEN) for a, s in TOKEN_ALIASES]
    found = clean.extract_skills(table(spark, sf_dir, "documents"), words, "text")
    return plain(found.select("doc_id", "skills"))


def extract_skills_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary as a table, with blanks, dots, hyphens and slashes inside its tokens."""
    words = [SkillAlias(word, word, TOKEN) for word in (*HARD_TOKENS, "que", "los")]
    aliases = spark.createDataFrame(words, SKILL_SCHEMA)
    found = clean.extract_skills(table(spark, sf_dir, "documents"), aliases, "text")
    return plain(found.select("doc_id", "skills"))


def lineage(lk: Lake) -> DataFrame:
    """Batch and file of each posting; of the file its folder, which is named after the platform."""
    found = clean.with_lineage(lk.bronze.drop("batch_id"), BATCH_ID)
    return found.select("record_id", "source", "batch_id", F.regexp_extract("source_file", "/([^/]+)/[^/]+$", 1).alias("source_folder"))


def dedup(lk: Lake) -> DataFrame:
    kept = clean.dedup(clean.valid_rows(lk.bronze), lk.dicts.source_priority)
    return kept.select(*lake_build.RAW_COLUMNS, "fingerprint")


def dedup_audit(lk: Lake) -> DataFrame:
    return clean.dedup_audit(clean.valid_rows(lk.bronze), lk.dicts.source_priority)


def upsert(lk: Lake) -> DataFrame:
    """Postings of two platforms, then a batch that changes those of one and adds the third's."""
    rows = lk.p.select("record_id", "source", "role", "salary_min", "salary_max")
    batch = rows.filter(F.col("source") != SOURCES[0]).withColumn("salary_max", F.col("salary_max") + 1000)
    return relate.upsert(rows.filter(F.col("source") != SOURCES[2]), batch, ["record_id"])


def _split_batches(lk: Lake) -> tuple[DataFrame, DataFrame]:
    """Raw postings in two batches, copies and their originals apart, so that either may come first."""
    raw = lk.raw.select(*lake_build.RAW_COLUMNS)
    number = F.regexp_extract("record_id", ":(-?[0-9]+)", 1).cast("long")
    later = ((number % 4) < 2) != F.col("record_id").endswith("-d")
    return raw.where(~later), raw.where(later)


def silver_two_batches(lk: Lake) -> DataFrame:
    """Silver after two batches, the second of which repeats and replaces postings of the first."""
    root = scratch(lk.spark, "batches")
    for number, batch in enumerate(_split_batches(lk)):
        lake_build.add_batch(lk.spark, batch, lk.dicts, root, f"batch-{number}", n_buckets=TEST_BUCKETS, gold_buckets=GOLD_BUCKETS)
    return lake_build.silver_by_month(root, "posting").read(lk.spark)


def all_gold(tables: dict[str, DataFrame]) -> DataFrame:
    """Every column of the four Gold tables in one frame, numbers as DOUBLE."""
    keys = {"job_skill": ("record_id", "skill"), "skill_freq": ("skill",), "city_salary": ("city",), "role_demand": ("role",)}
    measures = ("postings", "share", "rank", "n", "salary_min", "salary_max", "mean_mid", "median_mid", "companies", "cities")
    parts = []
    for name, df in tables.items():
        key = [F.col(keys[name][0]).alias("key"), (F.col(keys[name][1]) if len(keys[name]) > 1 else F.lit(None).cast("string")).alias("skill")]
        own = [(F.col(m) if m in df.columns else F.lit(None)).cast("double").alias(m) for m in measures]
        parts.append(df.select(F.lit(name).alias("table_name"), *key, *own))
    return reduce(DataFrame.unionByName, parts)


def gold_refresh(lk: Lake) -> DataFrame:
    """Gold after two batches: the second brings a platform, changes postings of the first and withdraws some."""
    root = scratch(lk.spark, "refresh")
    number = F.regexp_extract("record_id", ":(-?[0-9]+)", 1).cast("long")
    early = lk.p.where(F.col("source") != SOURCES[2])
    # As they were before: other role, city, company, salary, month and skills.
    changed = early.where(number % 5 == 0)
    before = changed.withColumns(
        {
            "role": F.lit("former role"),
            "city": F.when(number % 2 == 0, "FORMER CITY").otherwise(F.col("city")),
            "company": F.concat(F.lit("former "), "company"),
            "salary_max": F.col("salary_max") + 100_000,
            "posted_month": F.col("posted_month") - 1,
            "skills": F.array_union(F.slice("skills", 1, 1), F.array(F.lit("former skill"))),
        }
    )
    withdrawn = early.where(number % 7 == 0).withColumns({"record_id": F.concat("record_id", F.lit("-w")), "role": F.lit("withdrawn role")})
    maintain.apply(lk.spark, root, early.where(number % 5 != 0).unionByName(before).unionByName(withdrawn), None, "batch-0", GOLD_BUCKETS)
    came = lk.p.where(F.col("source") == SOURCES[2]).unionByName(changed)
    maintain.apply(lk.spark, root, came, before.unionByName(withdrawn), "batch-1", GOLD_BUCKETS)
    return all_gold(maintain.read_gold(lk.spark, root, GOLD_BUCKETS))


# --- streams -------------------------------------------------------------------------


def _events_as_json(spark: SparkSession, sf_dir: str) -> str:
    """Events as lines of JSON, the payload a message queue would carry."""
    path = scratch(spark, "events-json")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("string"))
    events.select(F.to_json(F.struct(*events.columns)).alias("value")).write.mode("overwrite").text(path)
    return path


def _event_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of postings with their one skill."""
    s = streams.posting_stream(spark, "text", {"path": _events_as_json(spark, sf_dir)}, EVENT_SCHEMA)
    return s.select(
        F.col("event_id").cast("string").alias("record_id"),
        F.to_timestamp("ts").alias("posted_at"),
        F.concat(F.lit("company-"), F.col("user_id").cast("string")).alias("company"),
        F.col("event_type").alias("raw_title"),
        F.get_json_object("props", "$.k").alias("skill"),
    )


def _drained(spark: SparkSession, s: DataFrame) -> DataFrame:
    path = scratch(spark, "stream")
    sinks.sink_files(s, path, scratch(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.schema(s.schema).parquet(path)


def stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_drained(spark, _event_postings(spark, sf_dir)))


def _raw_stream(lk: Lake) -> DataFrame:
    path = layers.layer_path(lk.root, layers.BRONZE, "posting")
    return streams.posting_stream(lk.spark, "parquet", {"path": path}, lk.bronze.schema)


def stream_clean(lk: Lake) -> DataFrame:
    return _drained(lk.spark, streams.clean_stream(_raw_stream(lk), lk.dicts))


def stream_dedup(lk: Lake) -> DataFrame:
    """Fingerprints only: which copy comes first is not fixed on a stream."""
    s = _raw_stream(lk).withColumn("posted_at", F.col("posted_on").cast("timestamp"))
    return _drained(lk.spark, streams.dedup_stream(s, "posted_at", "30 days").select("fingerprint"))


def _heat(spark: SparkSession, sf_dir: str, size: str, slide: str | None) -> DataFrame:
    heat = streams.heat_stream(_event_postings(spark, sf_dir), "posted_at", ["raw_title"], size, slide, delay="1 day")
    path, key = scratch(spark, "heat"), ["window_start", "window_end", "raw_title"]
    sinks.sink_upsert(heat, path, key, scratch(spark, "heat-checkpoint"), mode="update").awaitTermination()
    return plain(sinks.read_upserted(spark, path, key))


def stream_heat_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heat(spark, sf_dir, "1 day", None)


def stream_heat_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heat(spark, sf_dir, "2 days", "1 day")


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last posting of each company and role."""
    path, key = scratch(spark, "upsert"), ["company", "raw_title"]
    version = F.struct("posted_at", "record_id")
    s = _event_postings(spark, sf_dir).withColumn("version", version)
    sinks.sink_upsert(s, path, key, scratch(spark, "upsert-checkpoint"), version="version").awaitTermination()
    return plain(sinks.read_upserted(spark, path, key, "version").drop("version"))


# --- analytics -----------------------------------------------------------------------


def skill_rules(lk: Lake) -> DataFrame:
    rules = analytics.skill_rules(lk.p, MIN_SUPPORT, MIN_CONFIDENCE)
    rounded = [F.round(c, 9).alias(c) for c in ("confidence", "lift", "support")]
    return rules.select(F.sort_array("antecedent").alias("antecedent"), "consequent", *rounded)


def skill_pagerank(lk: Lake) -> DataFrame:
    ranks = analytics.skill_pagerank(analytics.skill_cooccurrence(lk.p), PAGERANK_STEPS)
    return ranks.select("skill", F.round("rank", 9).alias("rank"))


def demand_forecast(lk: Lake) -> DataFrame:
    by_role = analytics.forecast(trends.monthly(lk.p, "role"), "role")
    asked = lk.p.select("posted_on", F.explode("skills").alias("skill"))
    by_skill = analytics.forecast(trends.monthly(asked, "skill"), "skill")
    return by_role.withColumnRenamed("role", "name").unionByName(by_skill.withColumnRenamed("skill", "name"))


def _cols(build: Callable[[DataFrame], DataFrame], *cols: str) -> Query:
    return on_lake(lambda lk: build(lk.bronze).select("record_id", *cols))


QUERIES: dict[str, Query] = {
    "read_source": on_lake(read_source),
    "file_census": on_lake(file_census),
    "fuse_sources": on_lake(fuse_sources),
    "unified_csv_roundtrip": on_lake(unified_csv_roundtrip),
    "layer_roundtrip": on_lake(layer_roundtrip),
    "warehouse_roundtrip": on_lake(warehouse_roundtrip),
    "warehouse_views": on_lake(warehouse_views),
    "jdbc_roundtrip": on_lake(jdbc_roundtrip),
    "graph_export_roundtrip": on_lake(graph_export_roundtrip),
    "run_summary": on_lake(run_summary),
    "valid_rows": on_lake(lambda lk: clean.valid_rows(lk.bronze).select("record_id", "source", "raw_title", "company")),
    "normalize_text": normalize_text,
    "standardize_role": on_lake(
        lambda lk: clean.standardize_role(lk.bronze, lk.dicts.role_rules, lk.dicts.other_role).select(
            "record_id", "raw_title", "role"
        )
    ),
    "standardize_city": on_lake(
        lambda lk: clean.standardize_city(lk.bronze, lk.dicts.city_aliases, lk.dicts.city_suffix).select(
            "record_id", "raw_city", "city"
        )
    ),
    "parse_salary": _cols(clean.parse_salary, "salary_text", "salary_min", "salary_max", "salary_months"),
    "extract_education": _cols(clean.extract_education, "req_text", "education", "education_rank"),
    "extract_experience": _cols(clean.extract_experience, "req_text", "exp_min_years", "exp_max_years"),
    "extract_skills_phrase": on_lake(
        lambda lk: clean.extract_skills(lk.bronze, skill_aliases()).select("record_id", "skills")
    ),
    "extract_skills_token": extract_skills_token,
    "extract_skills_dictionary": extract_skills_dictionary,
    "lineage": on_lake(lineage),
    "fingerprint": _cols(clean.with_fingerprint, "fingerprint"),
    "dedup": on_lake(dedup),
    "dedup_audit": on_lake(dedup_audit),
    "postings_with_skill": on_lake(
        lambda lk: relate.postings_with_skill(lk.p, lk.js).select("record_id", "role", "city", "skill")
    ),
    "posting_with_text": on_lake(
        lambda lk: relate.posting_with_text(lk.p, lk.text).select("record_id", "role", "raw_title", "description", "req_text")
    ),
    "having_any_skill": on_lake(
        lambda lk: relate.having_any_skill(lk.p, lk.js, WANTED_SKILLS).select("record_id", "role", "city")
    ),
    "having_all_skills": on_lake(
        lambda lk: relate.having_all_skills(lk.p, lk.js, WANTED_SKILLS[:2]).select("record_id", "role", "city")
    ),
    "postings_without_skill": on_lake(
        lambda lk: relate.without_skill(lk.p, lk.js).select("record_id", "source", "role", "city")
    ),
    "upsert": on_lake(upsert),
    "bronze": on_lake(lambda lk: lk.bronze.withColumn("source_folder", F.regexp_extract("source_file", "/([^/]+)/[^/]+$", 1)).drop("source_file")),
    "silver_posting": on_lake(lambda lk: lk.p.select(*lake_build.SILVER_COLUMNS)),
    "silver_text": on_lake(lambda lk: lk.text),
    "gold_job_skill": on_lake(lambda lk: gold.gold_job_skill(lk.p)),
    "gold_skill_freq": on_lake(lambda lk: gold.gold_skill_freq(lk.js, lk.p)),
    "gold_city_salary": on_lake(lambda lk: gold.gold_city_salary(lk.p)),
    "gold_role_demand": on_lake(lambda lk: gold.gold_role_demand(lk.p)),
    "gold_refresh": on_lake(gold_refresh),
    "silver_two_batches": on_lake(silver_two_batches),
    "quality_report": on_lake(lambda lk: quality.quality_report(clean.valid_rows(lk.bronze), lk.p, lk.bronze)),
    "completeness": on_lake(lambda lk: quality.completeness(lk.bronze.select(*lake_build.RAW_COLUMNS))),
    "nodes_job_posting": on_lake(lambda lk: graph.nodes_job_posting(lk.p)),
    "nodes_job_role": on_lake(lambda lk: graph.nodes_job_role(lk.p)),
    "nodes_skill": on_lake(lambda lk: graph.nodes_skill(lk.js)),
    "nodes_city": on_lake(lambda lk: graph.nodes_city(lk.p)),
    "nodes_company": on_lake(lambda lk: graph.nodes_company(lk.p)),
    "nodes_major": on_lake(lambda lk: graph.nodes_major(lk.p)),
    "rel_belongs_to_role": on_lake(lambda lk: graph.rel_belongs_to_role(lk.p)),
    "rel_located_in": on_lake(lambda lk: graph.rel_located_in(lk.p)),
    "rel_posted_by": on_lake(lambda lk: graph.rel_posted_by(lk.p)),
    "rel_requires": on_lake(lambda lk: graph.rel_requires(lk.js)),
    "rel_related_to_major": on_lake(lambda lk: graph.rel_related_to_major(lk.p)),
    "rel_role_requires_skill": on_lake(lambda lk: graph.rel_role_requires_skill(lk.p, 30, 10)),
    "node_counts": on_lake(lambda lk: graph.node_counts(lk.graph[0])),
    "edge_counts": on_lake(lambda lk: graph.edge_counts(lk.graph[1])),
    "graph_merge": on_lake(graph_merge),
    "dangling_edges": on_lake(dangling_edges),
    "overview": on_lake(lambda lk: serve.overview(*lk.graph, lk.counts, lk.counts)),
    "job_roles": on_lake(lambda lk: serve.job_roles(lk.counts)),
    "role_detail": on_lake(lambda lk: serve.role_detail(lk.role_counts, ROLE)),
    "job_postings": on_lake(lambda lk: serve.job_postings(lk.p, ROLE, None, SKILL, MAJOR, page=2)),
    "job_posting_detail": on_lake(lambda lk: serve.job_posting(lk.p, lk.text, RECORD_ID).drop("fingerprint")),
    "skills": on_lake(lambda lk: serve.skills(lk.counts)),
    "cities": on_lake(lambda lk: serve.cities(lk.counts)),
    "majors": on_lake(lambda lk: serve.majors(lk.counts)),
    "role_skills": on_lake(lambda lk: serve.role_skills(lk.counts, top_n=3)),
    "skill_roles": on_lake(lambda lk: serve.skill_roles(lk.counts)),
    "city_skills": on_lake(lambda lk: serve.city_skills(lk.counts, top_n=5)),
    "role_cities": on_lake(lambda lk: serve.role_cities(lk.counts)),
    "role_city_skills": on_lake(lambda lk: serve.role_city_skills(lk.counts)),
    "major_roles": on_lake(lambda lk: serve.major_roles(lk.counts)),
    "role_subgraph": on_lake(lambda lk: serve.role_subgraph(lk.counts, ROLE)),
    "skill_graph": on_lake(lambda lk: serve.skill_graph(lk.counts, SKILL)),
    "search": on_lake(lambda lk: lk.names.search(lk.spark, SEARCH_TEXT)),
    "role_trend": on_lake(lambda lk: trends.role_trend(lk.p)),
    "skill_trend": on_lake(lambda lk: trends.skill_trend(lk.p)),
    "city_comparison": on_lake(lambda lk: trends.city_comparison(lk.p)),
    "city_role_matrix": on_lake(lambda lk: trends.city_role_matrix(lk.p)),
    "city_skill_diff": on_lake(lambda lk: trends.city_skill_diff(lk.p, CITY, OTHER_CITY)),
    "city_distribution": on_lake(lambda lk: trends.city_distribution(lk.p)),
    "stream_source": stream_source,
    "stream_clean": on_lake(stream_clean),
    "stream_dedup": on_lake(stream_dedup),
    "stream_heat_tumbling": stream_heat_tumbling,
    "stream_heat_sliding": stream_heat_sliding,
    "stream_upsert": stream_upsert,
    "skill_cooccurrence": on_lake(lambda lk: analytics.skill_cooccurrence(lk.p)),
    "skill_rules": on_lake(skill_rules),
    "core_skills": on_lake(lambda lk: analytics.core_skills(analytics.skill_cooccurrence(lk.p))),
    "skill_pagerank": on_lake(skill_pagerank),
    "role_similarity": on_lake(lambda lk: analytics.role_similarity(lk.p)),
    "recommend_skills": on_lake(lambda lk: analytics.recommend_skills(lk.counts, ROLE, KNOWN_SKILLS)),
    "demand_forecast": on_lake(demand_forecast),
}
QUERIES |= {name: as_double(QUERIES[name], columns) for name, columns in NULLABLE_NUMBERS.items()}

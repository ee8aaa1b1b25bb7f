"""Bronze, Silver and Gold from fused raw postings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import partial
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skillstrata.dictionaries import Dictionaries
from skillstrata.functions.text import is_filled, squeeze
from skillstrata.operators import clean, gold, graph, relate
from skillstrata.plans import maintain
from skillstrata.session import shuffles_dropped
from skillstrata.sources.buckets import BucketTable
from skillstrata.sources.fingerprints import N_BUCKETS, add, against_index
from skillstrata.sources.lake import BRONZE, CODEC, GOLD, SILVER, at_once, layer_path, read_layer, write_layer

MONTHS_AT_LEAST = 12  # that a batch touches, for the number of parts a month is dealt in
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
JIT_LIMIT = 8_000  # bytes of a method that the JVM compiles

RAW_COLUMNS = (
    "record_id",
    "source",
    "raw_title",
    "raw_city",
    "company",
    "major",
    "salary_text",
    "req_text",
    "description",
    "posted_on",
)
SILVER_COLUMNS = (
    "record_id",
    "source",
    "title",
    "role",
    "city",
    "company",
    "major",
    "salary_min",
    "salary_max",
    "education",
    "education_rank",
    "exp_min_years",
    "exp_max_years",
    "skills",
    "has_description",
    "posted_on",
    "posted_month",
    "fingerprint",
)
SILVER_TYPES = (
    "record_id string, source string, title string, role string, city string, company string, major string, salary_min bigint, salary_max bigint, "
    "education string, education_rank int, exp_min_years int, exp_max_years int, skills array<string>, has_description boolean, "
    "posted_on date, posted_month int, fingerprint string"
)
TEXT_TYPES = "record_id string, raw_title string, description string, salary_text string, req_text string"
TEXT_COLUMNS = ("record_id", "raw_title", "description", "salary_text", "req_text")


def build_bronze(fused: DataFrame, batch_id: str) -> DataFrame:
    """Fused raw postings with batch, source file and fingerprint."""
    return clean.with_fingerprint(clean.with_lineage(fused, batch_id))


def unique_postings(bronze: DataFrame, dicts: Dictionaries) -> DataFrame:
    """Valid postings, one for each fingerprint: what both Silver tables are made of."""
    return clean.dedup(clean.valid_rows(bronze), dicts.source_priority)


def refine(postings: DataFrame, dicts: Dictionaries, keep: Sequence[str] = ()) -> DataFrame:
    """Standard role, city, salary, requirements and skills; works on a stream too. Columns to ``keep`` come after Silver's."""
    df = clean.standardize_role(postings, dicts.role_rules, dicts.other_role)
    df = clean.standardize_city(df, dicts.city_aliases, dicts.city_suffix)
    df = clean.parse_salary(df, dicts.days_per_month)
    df = clean.extract_education(df, dicts.education_levels)
    df = clean.extract_experience(df)
    df = clean.extract_skills(df, dicts.skills)
    df = df.withColumns(
        {
            "title": squeeze(F.col("raw_title")),
            "company": squeeze(F.col("company")),
            "major": squeeze(F.col("major")),
            "has_description": is_filled(F.col("description")),
            "posted_month": F.year("posted_on") * 100 + F.month("posted_on"),
        }
    )
    return df.select(*SILVER_COLUMNS, *keep)


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """While it lasts, stages whose generated method is too long for the JIT are made of shorter ones."""
    before = spark.conf.get(HUGE_METHOD, None)
    spark.conf.set(HUGE_METHOD, str(JIT_LIMIT))
    try:
        yield
    finally:
        spark.conf.unset(HUGE_METHOD) if before is None else spark.conf.set(HUGE_METHOD, before)


def build_silver(bronze: DataFrame, dicts: Dictionaries) -> DataFrame:
    """Wide cleaned postings."""
    return refine(unique_postings(bronze, dicts), dicts)


def build_silver_text(bronze: DataFrame, dicts: Dictionaries) -> DataFrame:
    """Text detail of the postings in Silver."""
    return unique_postings(bronze, dicts).select(*TEXT_COLUMNS)


def write_bronze(spark: SparkSession, fused: DataFrame, root: str, batch_id: str) -> DataFrame:
    """Writes a batch of Bronze as it comes, with no shuffle: sources are few.

    Each batch has its own folder, so another batch stays and the same one is replaced whole.
    """
    write_layer(build_bronze(fused, batch_id), root, BRONZE, f"posting/batch={quote(batch_id)}", ["source"], gather=False)
    return read_bronze(spark, root)


def read_bronze(spark: SparkSession, root: str) -> DataFrame:
    """The raw postings of all batches; ``batch_id`` is a column of the files."""
    return read_layer(spark, root, BRONZE, "posting").drop("batch")


def silver_by_month(root: str, table: str) -> BucketTable:
    """A Silver table that batches are added to: ``posting`` or ``posting_text``, in one bucket for each month."""
    columns = {"posting": SILVER_TYPES, "posting_text": f"{TEXT_TYPES}, fingerprint string, posted_month int"}[table]
    return BucketTable(layer_path(root, SILVER, f"{table}_by_month"), StructType.fromDDL(columns), ("posted_month",), by_value=True)


def changes_of(spark: SparkSession, fused: DataFrame, dicts: Dictionaries, root: str, batch_id: str, n_buckets: int = N_BUCKETS) -> DataFrame:
    """What a batch does to Silver: its rows with their text and ``sign``, 1 for postings that came, -1 for those replaced.

    Written to the lake, so that a run that broke off finds the same changes again.
    """
    path = layer_path(root, SILVER, f"changes/batch={quote(batch_id)}")
    came_path, went_path = f"{path}/sign=1", f"{path}/sign=-1"
    try:
        # Written last, so both are whole.
        spark.read.parquet(went_path)
        return spark.read.parquet(path).drop("replaces")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    write_bronze(spark, fused, root, batch_id)
    batch = read_layer(spark, root, BRONZE, f"posting/batch={quote(batch_id)}")
    unique = clean.dedup(clean.valid_rows(batch), dicts.source_priority)
    new = against_index(spark, root, unique, dicts.source_priority, n_buckets)
    # Texts ride along: joined again they would move with the whole rows once more.
    texts = F.struct(*[F.col(c) for c in TEXT_COLUMNS[1:]]).alias("text")
    with short_methods(spark):
        refine(new.withColumn("text", texts), dicts, ["text", "replaces"]).write.mode("overwrite").option("compression", CODEC).parquet(came_path)
    # A fingerprint holds the day, so what a posting replaces is in its own month.
    replaced = spark.read.parquet(came_path).where("replaces").select("fingerprint", "posted_month")
    posting, text = silver_by_month(root, "posting"), silver_by_month(root, "posting_text")
    months = posting.touched(replaced)
    held, texts_of = posting.read(spark, months), text.read(spark, months).select("fingerprint", texts)
    if months:
        # Few of the stored postings are replaced, and the rest need not move for the join.
        marks = relate.key_marks(replaced, "fingerprint")
        held, texts_of = (relate.perhaps_marked(df, marks, "fingerprint") for df in (held, texts_of))
    went = held.join(replaced.select("fingerprint"), "fingerprint", "left_semi").join(texts_of, "fingerprint")
    went.select(*SILVER_COLUMNS, "text", F.lit(False).alias("replaces")).write.mode("overwrite").option("compression", CODEC).parquet(went_path)
    return spark.read.parquet(path).drop("replaces")


def with_came(spark: SparkSession, stored: DataFrame, came: DataFrame) -> DataFrame:
    """Rows of some months with those that came, which replace the stored ones of their fingerprints.

    One shuffle, by month and a part of it, which the write of whole months takes as it is.
    """
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // MONTHS_AT_LEAST)
    both = stored.withColumn("_came", F.lit(0)).unionByName(came.withColumn("_came", F.lit(1)))
    dealt = both.withColumn("_part", F.pmod(F.xxhash64("fingerprint"), F.lit(parts))).repartition("posted_month", "_part")
    newest = Window.partitionBy("posted_month", "_part", "fingerprint").orderBy(F.desc("_came"))
    return dealt.withColumn("_place", F.row_number().over(newest)).where("_place = 1 or fingerprint is null").select(stored.columns)


def add_batch(spark: SparkSession, fused: DataFrame, dicts: Dictionaries, root: str, batch_id: str, n_buckets: int = N_BUCKETS, gold_buckets: int = 64) -> DataFrame:
    """Takes a batch of raw postings into a lake kept by batches, and returns its ``changes_of`` Silver.

    The batch is deduped in itself and against the index of what is stored; the months of its new
    postings are rewritten, all others stay, and Gold is maintained from the changes alone. A
    lake may begin with its first batch. The same batch again changes nothing.
    """
    with shuffles_dropped(spark):
        return _add_batch(spark, fused, dicts, root, batch_id, n_buckets, gold_buckets)


def _add_batch(spark: SparkSession, fused: DataFrame, dicts: Dictionaries, root: str, batch_id: str, n_buckets: int, gold_buckets: int) -> DataFrame:
    changes = changes_of(spark, fused, dicts, root, batch_id, n_buckets)
    came = changes.where("sign = 1")
    month = F.col("posted_month")
    rows = {
        "posting": came.select(*SILVER_COLUMNS),
        "posting_text": came.select("record_id", "text.*", "fingerprint", month),
    }

    def rewrite(name: str) -> None:
        table = silver_by_month(root, name)
        if table.tag(spark) != batch_id:
            months = table.touched(came)
            held = set(table.current(spark)).intersection(months)
            whole = with_came(spark, table.read(spark, months), rows[name]) if held else rows[name]
            table.replace(spark, whole, months, batch_id, gather=not held)

    at_once([partial(rewrite, name) for name in rows])
    maintain.apply(spark, root, came, changes.where("sign = -1"), batch_id, gold_buckets)
    # Last: until the index has them, a run that broke off would take the same postings again.
    add(spark, root, came, n_buckets)
    return changes


def write_unique(spark: SparkSession, root: str, dicts: Dictionaries, bronze: DataFrame | None = None) -> DataFrame:
    """Writes the valid postings, one for each fingerprint: the dedup is the one wide shuffle, and both Silver tables read its result."""
    write_layer(unique_postings(read_bronze(spark, root) if bronze is None else bronze, dicts), root, SILVER, "posting_unique")
    return read_layer(spark, root, SILVER, "posting_unique")


def write_posting(spark: SparkSession, root: str, dicts: Dictionaries, stored: bool = True, bronze: DataFrame | None = None) -> None:
    """Writes Silver's postings out of the unique ones, ``stored`` before or, where nothing else needs these, out of Bronze."""
    if stored:
        unique = read_layer(spark, root, SILVER, "posting_unique")
    else:
        unique = unique_postings(read_bronze(spark, root) if bronze is None else bronze, dicts)
    with short_methods(spark):
        write_layer(refine(unique, dicts), root, SILVER, "posting", ["posted_month"], ["record_id"])


def write_text(spark: SparkSession, root: str) -> None:
    """Writes the text detail of Silver's postings out of the unique ones."""
    unique = read_layer(spark, root, SILVER, "posting_unique")
    write_layer(unique.select(*TEXT_COLUMNS), root, SILVER, "posting_text", sort_by=["record_id"])


def write_silver(spark: SparkSession, root: str, dicts: Dictionaries) -> DataFrame:
    """Writes both Silver tables."""
    write_unique(spark, root, dicts)
    at_once([partial(write_posting, spark, root, dicts), partial(write_text, spark, root)])
    return read_layer(spark, root, SILVER, "posting")


GOLD_TABLES = {
    "job_skill": gold.gold_job_skill,
    "skill_freq": lambda p: gold.gold_skill_freq(gold.gold_job_skill(p), p),
    "city_salary": gold.gold_city_salary,
    "role_demand": gold.gold_role_demand,
}


def write_gold(spark: SparkSession, root: str, names: Iterable[str] = tuple(GOLD_TABLES)) -> None:
    """Writes Gold tables out of Silver, all or those named."""
    p = read_layer(spark, root, SILVER, "posting")
    at_once([partial(write_layer, GOLD_TABLES[name](p), root, GOLD, name) for name in names])


def write_graph(spark: SparkSession, root: str, mapping: DataFrame | None = None, min_postings: int = 1, top_n: int | None = None) -> None:
    """Writes the node and edge tables next to Gold, for counts, search and export.

    ``mapping (posting_major, major)`` leads from the majors of postings to those of the graph; of the
    role-skill edges those of ``min_postings`` up are kept, the ``top_n`` of a role.
    """
    p, js = read_layer(spark, root, SILVER, "posting"), read_layer(spark, root, GOLD, "job_skill")
    names = graph.NODE_TABLES | graph.EDGE_TABLES
    tables = graph.build_nodes(p, js, mapping) | graph.build_edges(p, js, mapping, min_postings, top_n)
    at_once([partial(write_layer, table, root, GOLD, names[kind]) for kind, table in tables.items()])


def read_graph(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Node and edge tables by kind."""
    nodes = {kind: read_layer(spark, root, GOLD, name) for kind, name in graph.NODE_TABLES.items()}
    edges = {kind: read_layer(spark, root, GOLD, name) for kind, name in graph.EDGE_TABLES.items()}
    return nodes, edges


def build_lake(spark: SparkSession, fused: DataFrame, dicts: Dictionaries, root: str, batch_id: str) -> None:
    """The whole run: each layer reads what the one below has written."""
    write_bronze(spark, fused, root, batch_id)
    write_silver(spark, root, dicts)
    write_gold(spark, root)

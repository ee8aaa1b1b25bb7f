"""Gold kept up to date by signed changes.

A batch is the postings that came and those that went, a changed posting in both. Each Gold
measure is held as counts that a posting that went lowers again: a distinct count as (key,
value, count) rows of which those above zero are counted, salaries as the count of each
range, from which lowest, highest, mean and median follow. A batch is summed by key first,
then meets the buckets of its own keys and rewrites these; no other file is read, and Silver is
not read at all.

Every table remembers the batch it was last brought to. A run that broke off is run again
with the same batch, and tables that have it are left as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skillstrata.functions.ranking import dense_rank_desc, share_of_total
from skillstrata.operators.counts import ALL_MONTHS, GROUPINGS, KEYS, NO_MONTH, Counts, cube, part_of
from skillstrata.operators.gold import midpoint, salary_figures
from skillstrata.session import scratch
from skillstrata.sources.buckets import BucketTable
from skillstrata.sources.lake import GOLD, at_once, layer_path

BUCKETS_AT_LEAST = 12  # that an update touches, for the number of parts a bucket is dealt in
COLUMNS = ("record_id", "role", "city", "company", "major", "skills", "salary_min", "salary_max", "posted_month")

STATE = {
    # name: (columns, bucket keys, whether the key's value is the bucket)
    "job_skill": ("posted_month int, record_id string, skill string, n bigint", ("posted_month",), True),
    "skill_count": ("skill string, postings bigint", ("skill",), False),
    "city_values": ("city string, salary_min bigint, salary_max bigint, n bigint", ("city",), False),
    "city_salary": ("city string, n bigint, salary_min bigint, salary_max bigint, mean_mid double, median_mid double", ("city",), False),
    "role_values": ("role string, kind string, value string, n bigint", ("role", "kind", "value"), False),
    "role_ranges": ("role string, salary_min bigint, salary_max bigint, n bigint", ("role",), False),
    "counts": ("part int, role string, city string, major string, skill string, postings bigint", ("part",), True),
    "role_count": ("role string, postings bigint, companies bigint, cities bigint", ("role",), False),
    "total": ("name string, n bigint", ("name",), False),
}


def state(root: str, name: str, n_buckets: int = 64) -> BucketTable:
    columns, by, by_value = STATE[name]
    return BucketTable(layer_path(root, GOLD, f"state/{name}"), StructType.fromDDL(columns), by, n_buckets, by_value)


def merged(spark: SparkSession, table: BucketTable, delta: DataFrame, keys: Sequence[str], measures: Sequence[str], part_by: str | None = None, touched: Callable[[], list[int]] | None = None) -> tuple[DataFrame, list[int] | None]:
    """Rows ``(keys, measures, old_<measure>)`` of the touched buckets after ``delta``, and these buckets, None for all.

    A table that holds nothing yet is not asked which buckets are touched: ``delta`` would be made twice. With
    ``part_by``, one of the keys, rows are dealt by bucket and a part of it at once, which suits keys with hardly two rows.
    ``touched`` tells the buckets, or more of them, where ``delta`` is dear to make.
    """
    buckets = (touched() if touched else table.touched(delta)) if table.current(spark) else None
    old = table.read(spark, buckets).select(*keys, *measures, *[F.col(m).alias(f"old_{m}") for m in measures])
    zero = [F.lit(0).cast("long").alias(f"old_{m}") for m in measures]
    both = old.unionByName(delta.select(*keys, *measures, *zero))
    by = list(keys)
    if part_by:
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS_AT_LEAST)
        both = both.withColumn("_part", F.pmod(F.xxhash64(part_by), F.lit(parts))).repartition(*table.by, "_part")
        by.append("_part")
    return both.groupBy(*by).agg(*[F.sum(c).alias(c) for m in measures for c in (m, f"old_{m}")]), buckets


def update(spark: SparkSession, table: BucketTable, delta: DataFrame, keys: Sequence[str], measures: Sequence[str], batch_id: str, part_by: str | None = None, touched: Callable[[], list[int]] | None = None) -> None:
    """Adds the sums of ``delta`` to a table; rows whose first measure comes to zero go.

    A count below zero says that something went that never came: the update is refused.
    """
    if table.tag(spark) == batch_id:
        return
    rows, buckets = merged(spark, table, delta, keys, measures, part_by, touched)
    first = F.col(measures[0])
    checked = F.when(first >= 0, first).otherwise(F.raise_error(F.concat(F.lit(f"{table.path}: fewer than none of "), F.to_json(F.struct(*keys)))).cast("long"))
    table.replace(spark, rows.withColumn(measures[0], checked).where(first != 0), buckets, batch_id, gather=not part_by)


def apply(spark: SparkSession, root: str, came: DataFrame, went: DataFrame | None, batch_id: str, n_buckets: int = 64, only: Sequence[str] | None = None, parts: Sequence[int] | None = None) -> None:
    """Brings all Gold tables from before a batch to after it, or ``only`` some.

    ``came`` and ``went`` hold Silver's columns. A posting that went must be given as it was
    stored. ``batch_id`` is new with each batch, and the same when a batch is run again. A table
    left out stays behind until it is named with the same batch. ``city_values`` brings ``city_salary``
    and ``role_values`` brings ``role_count``. With ``parts`` the cube has only these, and no others later.
    """
    signed = came.select(*COLUMNS, F.lit(1).cast("long").alias("n"))
    if went is not None:
        signed = signed.unionByName(went.select(*COLUMNS, F.lit(-1).cast("long").alias("n")))
    path = scratch(spark, "signed")
    if went is not None or only is None:
        # Read by every table; a few tables out of stored postings read these themselves.
        signed.write.parquet(path)
        signed = spark.read.parquet(path)

    def summed(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")

    def table(name: str) -> BucketTable:
        return state(root, name, n_buckets)

    skills = signed.select("posted_month", "record_id", F.explode("skills").alias("skill"), "n")
    priced = signed.where("salary_min is not null")

    def salaries() -> None:
        ranges = summed(priced, "city", "salary_min", "salary_max")
        update(spark, table("city_values"), ranges, ("city", "salary_min", "salary_max"), ("n",), batch_id)
        cities = table("city_salary")
        buckets = cities.touched(ranges)
        cities.replace(spark, salary_rows(table("city_values").read(spark, buckets)), buckets, batch_id)

    def roles() -> None:
        kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value")) for kind in ("company", "city")])
        values = summed(signed.select("role", F.inline(kinds), "n").where("value is not null"), "role", "kind", "value")
        # Found before the values are written, so that a run that breaks off in between finds them again.
        turned, _ = merged(spark, table("role_values"), values, ("role", "kind", "value"), ("n",))
        change = (F.col("n") > 0).cast("long") - (F.col("old_n") > 0).cast("long")
        zero = F.lit(0).cast("long")
        sized = signed.select("role", F.col("n").alias("postings"), zero.alias("companies"), zero.alias("cities")).unionByName(
            turned.select(
                "role",
                zero.alias("postings"),
                F.when(F.col("kind") == "company", change).otherwise(0).alias("companies"),
                F.when(F.col("kind") == "city", change).otherwise(0).alias("cities"),
            )
        )
        measures = ("postings", "companies", "cities")
        sized = sized.groupBy("role").agg(*[F.sum(m).alias(m) for m in measures]).where("postings <> 0 or companies <> 0 or cities <> 0")
        update(spark, table("role_count"), sized, ("role",), measures, batch_id)
        update(spark, table("role_values"), values, ("role", "kind", "value"), ("n",), batch_id)

    def plain(name: str, delta: DataFrame, keys: Sequence[str], measure: str = "n") -> Callable[[], None]:
        return partial(update, spark, table(name), delta, keys, (measure,), batch_id)

    def cube_parts() -> list[int]:
        if parts is not None:
            return list(parts)
        months = signed.select(F.coalesce("posted_month", F.lit(NO_MONTH)).alias("month")).distinct().collect()
        return [part_of(at, month) for at in range(len(GROUPINGS)) for month in (ALL_MONTHS, *[r.month for r in months])]

    relation, ranges = ("posted_month", "record_id", "skill"), ("role", "salary_min", "salary_max")
    steps = {
        "job_skill": lambda: update(spark, table("job_skill"), skills, relation, ("n",), batch_id, part_by="record_id"),
        "skill_count": lambda: plain("skill_count", summed(skills, "skill").withColumnRenamed("n", "postings"), ("skill",), "postings")(),
        "role_ranges": lambda: plain("role_ranges", summed(priced, *ranges), ranges)(),
        "counts": lambda: update(spark, table("counts"), cube(signed, parts), ("part", *KEYS), ("postings",), batch_id, touched=cube_parts),
        "total": lambda: plain("total", summed(signed.select(F.lit("postings").alias("name"), "n"), "name"), ("name",))(),
        "city_values": salaries,
        "role_values": roles,
    }
    at_once([step for name, step in steps.items() if only is None or name in only])


def read_counts(spark: SparkSession, root: str, months: Sequence[int] | None = None, n_buckets: int = 64) -> Counts:
    """The cube of counts, over all months or some, for the answers of ``serve`` and ``analytics``."""
    companies = state(root, "role_count", n_buckets).read(spark).select("role", "companies")
    return Counts(partial(state(root, "counts").read, spark), companies, state(root, "role_ranges", n_buckets).read(spark), months)


def salary_rows(values: DataFrame) -> DataFrame:
    """Figures of each city out of how often it has each salary range."""
    by_mid = values.withColumn("mid", midpoint()).groupBy("city", "mid")
    return salary_figures(by_mid.agg(F.sum("n").alias("n"), F.min("salary_min").alias("low"), F.max("salary_max").alias("high")))


def read_gold(spark: SparkSession, root: str, n_buckets: int = 64) -> dict[str, DataFrame]:
    """The four Gold tables with the columns that a full build gives them."""

    def table(name: str) -> DataFrame:
        return state(root, name, n_buckets).read(spark)

    total = table("total").select("n")
    return {
        "job_skill": table("job_skill").select("record_id", "skill"),
        "skill_freq": dense_rank_desc(table("skill_count"), "postings", "rank").select(
            "skill", "postings", share_of_total(F.col("postings"), total).alias("share"), "rank"
        ),
        "city_salary": table("city_salary"),
        "role_demand": table("role_count").withColumn("share", share_of_total(F.col("postings"), total)),
    }

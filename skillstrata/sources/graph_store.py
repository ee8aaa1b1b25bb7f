"""Node and edge tables stored in buckets, into which exported tables are loaded any number of times."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skillstrata.session import shuffles_dropped
from skillstrata.sources.buckets import BUCKET, BucketTable
from skillstrata.sources.lake import at_once

SIDE_BY_SIDE = 3  # tables loaded at once, as the shuffles of each lie on the disks meanwhile


def keys_of(columns: list[str]) -> list[str]:
    return ["id"] if "id" in columns else ["src_id", "dst_id"]


def stored(root: str, kind: str, schema: StructType, n_buckets: int = 64) -> BucketTable:
    """The table of a kind, in buckets by node id or by the source of an edge."""
    return BucketTable(f"{root.rstrip('/')}/{kind}", schema, keys_of(schema.names)[:1], n_buckets)


def load(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], n_buckets: int = 64) -> dict[str, int]:
    """Puts tables in by key and returns how many buckets of each were rewritten.

    A row equal to the stored one is no change, so a second load of the same tables writes
    nothing, and a load with few changes rewrites their buckets alone. Nothing is removed.
    Of several rows of a key the highest counts.
    """
    rewritten: dict[str, int] = {}

    def one(kind: str, df: DataFrame) -> None:
        rewritten[kind] = _load_one(spark, stored(root, kind, df.schema, n_buckets), df)

    with shuffles_dropped(spark):
        at_once([partial(one, kind, df) for kind, df in tables.items()], SIDE_BY_SIDE)
    return rewritten


def _sums(table: BucketTable, rows: DataFrame) -> dict[int, tuple]:
    """Rows of each bucket and 128 bits of hash over them, in any order: only these leave a map task."""
    cells = [c for name in rows.columns for c in (F.col(name).isNull(), F.col(name))]
    hashes = [F.bit_xor(F.xxhash64(F.lit(seed), *cells)) for seed in range(2)]
    found = rows.groupBy(table.bucket_of().alias(BUCKET)).agg(F.count("*"), *hashes)
    return {bucket: tuple(sums) for bucket, *sums in found.collect()}


def _merged(spark: SparkSession, table: BucketTable, incoming: DataFrame, buckets: list[int]) -> DataFrame:
    """The rows of some buckets after a load, each key once, with ``_changed``; one shuffle of stored and incoming rows."""
    key = keys_of(incoming.columns)
    rest = [c for c in table.schema.names if c not in key]
    new = incoming.where(table.bucket_of().isin(buckets)).withColumn("_side", F.lit(1))
    both = table.read(spark, buckets).withColumn("_side", F.lit(0)).unionByName(new)
    aggregates, changed = [F.min("_side").alias("_first")], F.col("_first") == 1
    if rest:
        old = F.max(F.when(F.col("_side") == 0, F.struct(*rest)))
        aggregates += [F.max(F.struct("_side", *rest)).alias("_last"), old.alias("_old")]
        changed = changed | ~F.struct(*[F.col(f"_last.{c}") for c in rest]).eqNullSafe(F.col("_old"))
    rows = both.groupBy(*key).agg(*aggregates)
    return rows.select(*[F.col(c) if c in key else F.col(f"_last.{c}") for c in table.schema.names], changed.alias("_changed"))


def _load_one(spark: SparkSession, table: BucketTable, incoming: DataFrame) -> int:
    theirs = _sums(table, incoming)
    ours = _sums(table, table.read(spark, list(theirs)))
    differing = [b for b in theirs if theirs[b] != ours.get(b)]
    # More rows than are stored mean new ones, unless rows repeat; of the others it is asked before any is written.
    longer = [b for b in differing if b not in ours or theirs[b][0] > ours[b][0]]
    asked = [b for b in differing if b not in longer]
    if asked:
        found = _merged(spark, table, incoming, asked).where("_changed")
        asked = [r[0] for r in found.select(table.bucket_of().alias(BUCKET)).distinct().collect()]
    buckets = longer + asked
    if not buckets:
        return 0
    seen = Observation()
    rows = _merged(spark, table, incoming, buckets)
    watched = rows.observe(seen, F.collect_set(F.when(F.col("_changed"), table.bucket_of())).alias("changed"))
    table.replace(spark, watched, buckets, gather=False, changed=lambda: seen.get["changed"])
    return len(seen.get["changed"])

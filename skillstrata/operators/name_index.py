"""Search in names through an inverted index of character grams.

Every distinct name is filed under its grams of one to GRAM characters; posting lists are
bucketed by gram, nodes by name. A search looks up how long the lists of its text's grams are, reads
the shortest alone, checks its names exactly, and opens the buckets of nodes that have one.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skillstrata.functions.text import normalize
from skillstrata.session import scratch
from skillstrata.sources.buckets import BucketTable

GRAM = 3
TABLES = {
    "lists": ("gram string, low string", ("gram",)),
    "sizes": ("gram string, names bigint", ("gram",)),
    "nodes": ("low string, kind string, id string, name string", ("low",)),
}


def grams(low: str | Column, sizes: range | None = None) -> Column:
    """Distinct grams of a text: of 1 to GRAM characters, or of the given lengths."""
    low = F.col(low) if isinstance(low, str) else low

    def of(size: int) -> Column:
        starts = F.when(F.length(low) >= size, F.sequence(F.lit(1), F.length(low) - (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.substr(low, at, F.lit(size)))

    return F.array_distinct(F.concat(*map(of, sizes or range(1, GRAM + 1))))


def low_name(name: str | Column) -> Column:
    return F.lower(F.trim(name))


@dataclass(frozen=True)
class NameIndex:
    """An index below ``root``, written by ``build``."""

    root: str
    n_buckets: int = 64

    def table(self, name: str) -> BucketTable:
        columns, by = TABLES[name]
        return BucketTable(f"{self.root}/{name}", StructType.fromDDL(columns), by, self.n_buckets)

    def build(self, nodes: Mapping[str, DataFrame]) -> NameIndex:
        """Files the nodes ``(id, name)`` of each kind. Nodes without a name are found by no text."""
        own = [t.select(low_name("name").alias("low"), F.lit(kind).alias("kind"), "id", "name") for kind, t in nodes.items()]
        every = reduce(DataFrame.unionByName, own).where("low is not null")
        spark = every.sparkSession
        self.table("nodes").replace(spark, every, None)
        names = self.table("nodes").read(spark).select("low").distinct()
        self.table("lists").replace(spark, names.select(F.explode(grams("low")).alias("gram"), "low"), None)
        lists = self.table("lists").read(spark)
        self.table("sizes").replace(spark, lists.groupBy("gram").agg(F.count("*").alias("names")), None)
        return self

    def names(self, spark: SparkSession, wanted: str) -> DataFrame:
        """The distinct names that hold ``wanted``, out of the shortest list of its grams."""
        size = min(GRAM, len(wanted))
        asked = spark.range(1).select(F.explode(grams(F.lit(wanted), range(size, size + 1))).alias("gram"))
        sizes = self.table("sizes")
        # One row for a gram of the text.
        known = {r.gram: r.names for r in sizes.read(spark, sizes.touched(asked)).join(asked, "gram").collect()}
        every = [r.gram for r in asked.collect()]
        lists = self.table("lists")
        if any(gram not in known for gram in every):
            return lists.read(spark, []).select("low")
        rarest = min(every, key=lambda gram: (known[gram], gram))
        found = lists.read(spark, lists.touched(asked.where(F.col("gram") == rarest)))
        return found.where((F.col("gram") == rarest) & F.contains("low", F.lit(wanted))).select("low")

    def search(self, spark: SparkSession, text: str, limit: int | None = None) -> DataFrame:
        """Nodes whose name holds the text: exact match first, then prefix, then anywhere.

        The text is normalised as names were. Blank text finds nothing.
        """
        wanted = spark.range(1).select(normalize(F.lit(text))).head()[0] or ""
        nodes = self.table("nodes")
        if not wanted:
            found, hits = nodes.read(spark, []), nodes.read(spark, []).select("low")
        else:
            path = scratch(spark, "names")
            self.names(spark, wanted).write.parquet(path)
            hits = spark.read.schema("low string").parquet(path)
            found = nodes.read(spark, nodes.touched(hits))
        low = F.col("low")
        match = F.when(low == wanted, 0).when(low.startswith(wanted), 1).otherwise(2).cast("bigint")
        every = found.join(hits, "low").select("kind", "id", "name", match.alias("match")).orderBy("match", "name", "kind", "id")
        return every if limit is None else every.limit(limit)

"""Connected components of a table of links, by joins and grouping alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillstrata.llm.common import forget, stored

MAX_ROUNDS = 100


def _distinct(links: DataFrame) -> DataFrame:
    return links.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``links(a, b)``; root is the smallest node it reaches.

    Large-star and small-star rounds: each node hands its larger, then its smaller neighbours
    to the smallest node it knows. The number of rounds grows with the logarithm of the
    longest path, and a node's neighbours are never gathered in a list.
    """
    links = stored(_distinct(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")).select("of", F.least("of", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(_distinct(large), "links")
        forget(links)
        # small-star: a node's smaller neighbours, and the node itself, hang on the smallest.
        least = large.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("of"))
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
        links = stored(_distinct(small), "links")
        forget(large)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now
    raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")

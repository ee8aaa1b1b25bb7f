"""Merkle manifest of a dataset with proofs by descent (operator 11).

Rows become leaf digests, ordered within their source; every FANOUT consecutive nodes become one
node above, up to the source's root, and the sources' roots likewise up to the dataset's. The
manifest is content-addressed: a record maps a node's digest to its children's digests, and
nothing else is needed to prove a leaf.

Requests for leaves descend from the root: a leaf's rank, in digits of base FANOUT, names the
child to follow at each node, and the children not chosen are collected as that step's segment.
All requests below a node descend together, so there is one row for a node on the way and no
digest is a hot key. At the leaves the segments, reversed, are the proof.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillstrata.llm.common import partitions, stored
from skillstrata.session import scratch

FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
MAX_DEPTH = 15  # 2**60 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "struct<left:string,right:string>"


def digest(*parts: str | Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: its length in bytes, a colon, itself; NULL is a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(**changed: Column) -> Column:
    return digest(*[field(changed.get(name, F.col(name))) for name in FIELDS])


def group_key(source: Column) -> Column:
    """A key that is never NULL and sorts NULL first, then by bytes."""
    return F.when(source.isNull(), "0").otherwise(F.concat(F.lit("1"), source))


def numbered(df: DataFrame, group: str, by: Sequence[str]) -> DataFrame:
    """The rows with ``rank``, from 0 within their group in the order of ``by``, and ``n``, the group's rows.

    Rows are range-partitioned and sorted; a partition's share of each group is counted, and a
    running sum over these counts, a row for a partition and group, gives where each begins. A
    group of any size is spread over partitions. Rows alike in ``by`` are ranked in any order.
    """
    dealt = df.repartitionByRange(partitions(df.sparkSession), group, *by).sortWithinPartitions(group, *by)
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "numbered")
    shares = dealt.groupBy(group, "part").agg(F.count("*").alias("share"), F.min("at").alias("first"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(
        group,
        "part",
        (F.coalesce(F.sum("share").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("share").over(Window.partitionBy(group)).alias("n"),
    )
    return dealt.join(shares, [group, "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def depth_of(n: Column) -> Column:
    """Levels above the leaves of a tree of so many leaves; 0 for one leaf."""
    return sum(((n > FANOUT**k).cast("int") for k in range(MAX_DEPTH)), F.lit(0))


@dataclass
class Forest:
    """A tree for each group over ranked leaves, with its records in one content-addressed store."""

    leaves: DataFrame  # group, rank, n, digest and whatever came with them
    nodes: DataFrame | None  # group, idx, depth, digest, children, level; None where no tree has a level
    depth: int

    def records(self, level: int) -> DataFrame:
        """Digest to children, of one level. Equal digests have equal children."""
        return self.nodes.where(F.col("level") == level).groupBy("digest").agg(F.first("children").alias("children"))

    def roots(self) -> DataFrame:
        """``(group, depth, digest)`` of each tree."""
        lone = self.leaves.where("n = 1").select("group", F.lit(0).alias("depth"), "digest")
        if self.nodes is None:
            return lone
        return lone.unionByName(self.nodes.where("level = depth").select("group", "depth", "digest"))


def grow(leaves: DataFrame) -> Forest:
    """Forest over ``numbered`` leaves ``(group, rank, n, digest)``, written level by level."""
    spark = leaves.sparkSession
    folder = scratch(spark, "merkle")
    depth = leaves.agg(F.max(depth_of(F.col("n")))).head()[0] or 0
    below = leaves.select("group", F.col("rank").alias("idx"), depth_of(F.col("n")).alias("depth"), "digest")
    for level in range(1, depth + 1):
        runs = below.where(F.col("depth") >= level).groupBy("group", "depth", F.shiftright("idx", FANOUT_BITS).alias("idx"))
        children = F.transform(F.sort_array(F.collect_list(F.struct(F.col("idx").alias("i"), "digest"))), lambda x: x["digest"])
        above = runs.agg(children.alias("children")).withColumn("digest", digest(F.array_join("children", "")))
        above.write.parquet(f"{folder}/level={level}")
        below = spark.read.parquet(f"{folder}/level={level}")
    return Forest(leaves, spark.read.parquet(folder) if depth else None, depth)


def _segment(children: Column, digit: Column) -> Column:
    """The children left and right of the one chosen, each side as one string."""
    left = F.array_join(F.slice(children, F.lit(1), digit), "")
    right = F.array_join(F.slice(children, digit + 2, F.lit(FANOUT)), "")
    return F.struct(left.alias("left"), right.alias("right"))


def descend(forest: Forest, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests with the ``path`` from the root to their leaves and what ``starts`` carries.

    ``starts``: group, depth, digest of each tree's root, ``path`` so far, and other columns;
    ``requests``: group, rank, and other columns. The path has one segment for a level.
    """
    carried = [c for c in starts.columns if c not in ("depth", "digest", "path")]
    asked = [c for c in requests.columns if c not in ("group", "rank")]
    found = requests.join(starts.where("depth = 0").select(*carried, "path"), "group").select(*carried, "rank", *asked, "path")
    if not forest.depth:
        return found
    requests = requests.withColumn("idx", F.shiftright("rank", FANOUT_BITS))
    wanted = {1: requests.select("group", "idx").distinct()}
    for level in range(2, forest.depth):
        wanted[level] = wanted[level - 1].select("group", F.shiftright("idx", FANOUT_BITS).alias("idx")).distinct()
    columns = [*carried, "idx", "digest", "path"]
    front = None
    for level in range(forest.depth, 0, -1):
        begun = starts.where(F.col("depth") == level).withColumn("idx", F.lit(0).cast("long")).select(columns)
        front = begun if front is None else front.unionByName(begun)
        opened = front.join(forest.records(level), "digest")
        if level == 1:
            break
        steps = opened.select(*carried, "idx", "path", "children", F.posexplode("children").alias("digit", "child"))
        steps = steps.select(*carried, (F.col("idx") * FANOUT + F.col("digit")).alias("idx"), "digit", "child", "path", "children")
        steps = steps.join(wanted[level - 1], ["group", "idx"], "left_semi")
        path = F.concat("path", F.array(_segment(F.col("children"), F.col("digit"))))
        front = steps.select(*carried, "idx", F.col("child").alias("digest"), path.alias("path"))
    together = requests.groupBy("group", "idx").agg(F.collect_list(F.struct("rank", *asked)).alias("asked"))
    opened = opened.join(together, ["group", "idx"]).select(*carried, "path", "children", F.explode("asked").alias("one"))
    digit = F.col("one.rank").bitwiseAND(FANOUT - 1).cast("int")
    path = F.concat("path", F.array(_segment(F.col("children"), digit))).alias("path")
    return found.unionByName(opened.select(*carried, *[F.col(f"one.{c}").alias(c) for c in ("rank", *asked)], path))


def proof(path: Column) -> Column:
    """Siblings from the leaf to the root, left to right, as one string."""
    return F.array_join(F.transform(F.reverse(path), lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(F.reverse(path), leaf, lambda node, s: digest(s["left"], node, s["right"]))


@dataclass
class Manifest:
    root: str | None  # None for an empty table
    sources: Forest
    top: Forest

    def subroots(self) -> DataFrame:
        """``(source_key, subroot)``."""
        return self.sources.roots().select("group", F.col("digest").alias("subroot"))

    def prove(self, requests: DataFrame) -> DataFrame:
        """``requests(group, rank, ...)`` with ``subroot``, ``root`` and ``path``."""
        none = F.array().cast(f"array<{SEGMENT}>")
        root = self.top.roots().withColumn("path", none)
        entries = self.top.leaves.select("group", "rank", "source_key", F.col("digest").alias("subroot"))
        down = descend(self.top, root, entries).select(F.col("source_key").alias("group"), "subroot", "path")
        starts = down.join(self.sources.roots().select("group", "depth", "digest"), "group")
        return descend(self.sources, stored(starts, "starts"), requests).withColumn("root", F.lit(self.root).cast("string"))


def leaves(docs: DataFrame, **extra: Column) -> DataFrame:
    """Ranked leaves of documents: ``group, rank, n, digest, doc_id`` and the columns of ``extra``.

    Any field may be NULL. Within a source NULL ids come first; repeated rows are leaves of
    their own, side by side, of equal digest. Columns beside the fields take no part.
    """
    rows = docs.select(group_key(F.col("source")).alias("group"), "doc_id", leaf_of().alias("digest"), *[c.alias(n) for n, c in extra.items()])
    return numbered(rows, "group", ("doc_id", "digest"))


def build(ranked: DataFrame) -> Manifest:
    """Manifest over ``leaves``."""
    sources = grow(ranked)
    subroots = sources.roots().select(F.lit("").alias("group"), F.col("group").alias("source_key"), "digest")
    top = grow(numbered(subroots, "group", ("source_key",)))
    root = top.roots().head()
    return Manifest(root["digest"] if root else None, sources, top)

"""Exact search for the k highest inner products with ball trees (operator 10).

Vectors are dealt by a hash of their row into shards of bounded size, and each shard is indexed
once as a ball tree: nodes with a centre and a radius, and leaves of a few vectors. No vector in
a node scores more with a query than ``query . centre + |query| * radius``. A query visits a
shard's leaves from the highest such bound down, and stops where no bound reaches its k-th score.

Queries meet shards in blocks: each task has one shard and one block. A first round visits only
the best leaf of each shard; the highest k-th score of any shard is shared with all shards as
the score to reach in the second round.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillstrata.llm.common import stored

SHARD_ROWS = 4096
BLOCK_ROWS = 4096
LEAF_ROWS = 64
LOWEST = np.iinfo(np.int64).min
EXACT_FLOAT = 2**53


@dataclass
class Tree:
    """Vectors in leaf order; node i covers rows ``starts[i]`` to ``ends[i]``; children 2i+1 and 2i+2 where inner."""

    rows: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    depth: int


def narrow(vectors: np.ndarray) -> np.ndarray:
    """The integers in the smallest type that holds them."""
    for kind in (np.int8, np.int16, np.int32):
        if not vectors.size or (vectors.min() >= np.iinfo(kind).min and vectors.max() <= np.iinfo(kind).max):
            return vectors.astype(kind)
    return vectors


def build(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> Tree:
    """A balanced tree: each node is cut at the median of its widest direction among its own axes."""
    points = vectors.astype(np.float64)
    depth = max(0, math.ceil(math.log2(max(1, len(ids) / LEAF_ROWS))))
    nodes = 2 ** (depth + 1) - 1
    order = np.lexsort((rows, ids))
    starts, ends = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    ends[0] = len(ids)
    centres, radii = np.zeros((nodes, points.shape[1])), np.zeros(nodes)
    for i in range(nodes):
        a, b = starts[i], ends[i]
        own = points[order[a:b]]
        if b > a:
            centres[i] = own.mean(axis=0)
            radii[i] = np.sqrt(((own - centres[i]) ** 2).sum(axis=1).max())
        if 2 * i + 2 < nodes:
            middle = (a + b) // 2
            if b - a > 1:
                # Cut across the line from one far vector to another far one.
                far = own[((own - centres[i]) ** 2).sum(axis=1).argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                order[a:b] = order[a:b][np.argsort(own @ (other - far), kind="stable")]
            starts[2 * i + 1], ends[2 * i + 1] = a, middle
            starts[2 * i + 2], ends[2 * i + 2] = middle, b
    return Tree(rows[order], ids[order], narrow(vectors[order]), centres, radii, starts, ends, depth)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two integer arrays, exact; clipped to 64 bits where they are larger."""
    most = a.shape[1] * max(1.0, float(np.abs(a.astype(np.float64)).max(initial=0))) * max(1.0, float(np.abs(b.astype(np.float64)).max(initial=0)))
    if most < EXACT_FLOAT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, LOWEST + 1, np.iinfo(np.int64).max).astype(np.int64)


def search(tree: Tree, own: np.ndarray, queries: np.ndarray, reach: np.ndarray, k: int, most_leaves: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best of a shard for each query, LOWEST where there are fewer.

    ``own`` are the queries' own rows, which they do not find. Nothing below ``reach`` need be found. With ``most_leaves`` a query visits so many leaves.
    """
    n, width = len(queries), k
    best = np.full((n, width), LOWEST, np.int64)
    best_ids = np.full((n, width), np.iinfo(np.int64).max, np.int64)
    points = queries.astype(np.float64)
    norm = np.sqrt((points**2).sum(axis=1))
    reach = reach.copy()
    # Down the tree: which queries can still find something in each node.
    bounds = np.full((n, 1), np.inf)
    for level in range(tree.depth + 1):
        nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
        parents = bounds if level == 0 else np.repeat(bounds, 2, axis=1)
        most = points @ tree.centres[nodes].T + norm[:, None] * tree.radii[nodes]
        most = most + 1e-9 * np.abs(most) + 1e-6 * (1 + norm[:, None])  # for rounding
        most[:, tree.ends[nodes] == tree.starts[nodes]] = -np.inf
        bounds = np.where(np.minimum(most, parents) >= reach[:, None], most, -np.inf)
    first = 2**tree.depth - 1
    order = np.argsort(-bounds, axis=1, kind="stable")
    for visit in range(order.shape[1] if most_leaves is None else min(most_leaves, order.shape[1])):
        leaf = order[:, visit]
        bound = bounds[np.arange(n), leaf]
        live = np.flatnonzero((bound > -np.inf) & (bound >= reach))
        if not len(live):
            break
        by_leaf = live[np.argsort(leaf[live], kind="stable")]
        for group in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
            node = first + leaf[group[0]]
            rows = slice(tree.starts[node], tree.ends[node])
            found = products(queries[group], tree.vectors[rows])
            found[own[group][:, None] == tree.rows[rows][None, :]] = LOWEST
            scores = np.concatenate([best[group], found], axis=1)
            names = np.concatenate([best_ids[group], np.broadcast_to(tree.ids[rows], found.shape)], axis=1)
            # ~score falls as the score rises, for every 64-bit score.
            top = np.lexsort((names, ~scores), axis=1)[:, :width]
            best[group] = np.take_along_axis(scores, top, axis=1)
            best_ids[group] = np.take_along_axis(names, top, axis=1)
            reach[group] = np.maximum(reach[group], best[group, -1])
    return best, best_ids


def whole(x: Column) -> Column:
    return F.floor(F.lit(64.0) * x.cast("double")).cast("long")


def vectors_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(row, id, dim, v array<long>)`` of the vectors that take part; rows are numbered for good once written."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    taking = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    taking = taking.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, whole).alias("v"))
    return taking.select(F.monotonically_increasing_id().alias("row"), "id", F.size("v").alias("dim"), "v")


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_list()).astype(np.int64) if len(values) else np.zeros((0, 0), np.int64)


def _shards(vectors: DataFrame, shards: int) -> DataFrame:
    """``(dim, shard, tree binary)``, one row for about SHARD_ROWS vectors."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tree = build(rows["row"].to_numpy(np.int64), rows["id"].to_numpy(np.int64), _matrix(rows["v"]))
        return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "shard": [rows["shard"].iloc[0]], "tree": [pickle.dumps(tree, 5)]})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInPandas(run, "dim int, shard int, tree binary")


def _blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """``(dim, block, queries binary)``, one row for about BLOCK_ROWS queries with the scores to reach."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block = (rows["row"].to_numpy(np.int64), rows["id"].to_numpy(np.int64), narrow(_matrix(rows["v"])), rows["reach"].to_numpy(np.int64))
        return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "block": [rows["block"].iloc[0]], "queries": [pickle.dumps(block, 5)]})

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dim", "block").applyInPandas(run, "dim int, block int, queries binary")


def _met(trees: DataFrame, blocks: DataFrame, shards: int, n_blocks: int) -> DataFrame:
    """Each shard with each block, dealt out by the two numbers."""
    left = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return left.join(right, ["dim", "shard", "block"]).select("tree", "queries")


def _round(met: DataFrame, k: int, most_leaves: int | None) -> DataFrame:
    """``(query_row, query_id, place, vec_id, score)``: what a shard has for a query, best first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tree, block in zip(frame["tree"], frame["queries"], strict=True):
                own, ids, queries, reach = pickle.loads(block)
                scores, names = search(pickle.loads(tree), own, queries, reach, k, most_leaves)
                at, place = np.nonzero((scores != LOWEST) & (scores >= reach[:, None]))
                yield pd.DataFrame({"query_row": own[at], "query_id": ids[at], "place": place, "vec_id": names[at, place], "score": scores[at, place]})

    return met.mapInPandas(run, "query_row long, query_id long, place long, vec_id long, score long")


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the k highest inner products, all if there are fewer.

    Components are ``floor(64 * x)``. Queries are the rows where ``is_query`` (over the column
    ``id``) holds; candidates are all other rows of as many components. Equal scores go by
    smaller id. Rows with a NULL id, a NULL vector, or a NULL or non-finite component take no
    part. Rows with one id are vectors of their own: a query finds all rows but itself, and each row
    of a repeated query has its own ranks. Empty vectors score 0 with each other.
    No queries, no rows.
    """
    vectors = stored(vectors_of(df, id_col, vector_col), "vectors")
    queries = vectors.where(is_query)
    shards, blocks = max(1, math.ceil(vectors.count() / SHARD_ROWS)), max(1, math.ceil(queries.count() / BLOCK_ROWS))
    trees = stored(_shards(vectors, shards), "trees")

    unknown = queries.withColumn("reach", F.lit(LOWEST))
    first = _round(_met(trees, _blocks(unknown, blocks), shards, blocks), k, 1)
    reach = stored(first.where(F.col("place") == k - 1).groupBy(F.col("query_row").alias("row")).agg(F.max("score").alias("reach")), "reach")
    known = queries.join(reach, "row", "left").select("row", "id", "dim", "v", F.coalesce("reach", F.lit(LOWEST)).alias("reach"))
    second = _round(_met(trees, _blocks(known, blocks), shards, blocks), k, None)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    ranked = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")

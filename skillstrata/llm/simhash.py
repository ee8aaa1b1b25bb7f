"""Near duplicates by SimHash, linked through the general pigeonhole principle (operator 2).

Two fingerprints of 64 bits that differ in at most ``RADIUS`` bits agree, for any way to cut
the bits into m parts with thresholds that add up to RADIUS - m + 1, within the threshold in
some part; a threshold of -1 leaves its part out. So:

1. bits that vary together are put into the same part (correlations over all fingerprints);
2. thresholds are shared out by dynamic programming on the candidates each would cost;
3. a fingerprint is filed under the value of each part, or, at threshold 1, under the value
   with each single bit masked: those who meet under a key are the candidates;
4. candidates are verified inside bounded blocks. A block that is too large is cut by the same
   principle on the bits its key does not fix, over and over, so that no block is paired as
   a whole and no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillstrata.llm.common import pieces, stored, texts_of, without
from skillstrata.llm.components import components
from skillstrata.llm.membership import bit_table, filtered
from skillstrata.session import scratch

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
BLOCK = 256  # members of a block that are compared with each other; larger blocks are cut on
WORDS_AT_ONCE = 1 << 18
PIECE_BYTES = 4 << 20
# Cost of filing one key against that of comparing one pair.
KEY_COST, PAIR_COST = 20.0, 1.0

_xxh64 = partial(map, xxhash.xxh64_intdigest)


def bits_of(hashes: np.ndarray) -> int:
    """64 bits, of which one is set where over half the hashes have it set; 0 without hashes."""
    total = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), WORDS_AT_ONCE):
        part = np.ascontiguousarray(hashes[start : start + WORDS_AT_ONCE])
        total += _column_sums(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str) -> int:
    """64 bits, of which one is set where over half the shingles' hashes have it set; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)] + [b""] * (SHINGLE - 1)
        hashes = [xxhash.xxh64_intdigest(words[0], SEED)]
        return hashes[0]
    total = np.zeros(BITS, np.int64)
    n = len(words) - SHINGLE + 1
    for start in range(0, n, WORDS_AT_ONCE):
        part = words[start : start + WORDS_AT_ONCE + SHINGLE - 1]
        shingles = map(b" ".join, zip(part, part[1:], part[2:], strict=False))
        hashes = np.fromiter(_xxh64(shingles, repeat(SEED)), np.uint64, min(n - start, WORDS_AT_ONCE))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += _column_sums(bits)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of 0/1 bytes by column, eight columns to a machine word and at most 255 rows at a time."""
    rows = np.ascontiguousarray(bits).view(np.uint64)
    full = len(rows) // 255 * 255
    out = np.zeros(BITS, np.int64)
    if full:
        sums = rows[:full].reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64)
        out += sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    if full < len(rows):
        out += rows[full:].sum(axis=0, dtype=np.uint64).view(np.uint8).astype(np.int64)
    return out


def fingerprints(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row with ``fp long``, the fingerprint's 64 bits; NULL and empty texts have 0."""
    df = without(df, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col, PIECE_BYTES):
            values = np.fromiter(map(fingerprint, texts_of(piece, text_col)), np.uint64, piece.num_rows).view(np.int64)
            columns = dict(zip(piece.schema.names, piece.columns, strict=True))
            columns.pop(text_col)
            yield pa.RecordBatch.from_pydict({**columns, "fp": pa.array(values)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text_col)
    return df.mapInArrow(run, f"{fields}, fp long")


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, how many have both set: 64 x 64 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(bits), both + bits.T @ bits
        yield pa.RecordBatch.from_pydict({"n": [n], "both": pa.array([both.ravel()], pa.list_(pa.float64()))})

    parts = prints.select("fp").mapInArrow(run, "n long, both array<double>")
    sums = parts.select("n", F.posexplode("both").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    rows = sums.collect()  # BITS * BITS rows
    both = np.zeros(BITS * BITS)
    for row in rows:
        both[row.at] = row.value
    return (rows[0].n if rows else 0), both.reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """The bits in ``m`` parts of nearly equal size, each grown from a bit by the strongest correlations."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    link = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    left, parts = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        part = [max(left, key=lambda b: link[b, left].sum())]
        left.remove(part[0])
        while len(part) < size:
            best = max(left, key=lambda b: link[b, part].sum())
            part.append(best)
            left.remove(best)
        parts.append(tuple(sorted(part)))
    return parts


def mask_of(bits: tuple[int, ...]) -> int:
    """The bits as a signed 64-bit mask."""
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def meeting_pairs(prints: DataFrame, parts: list[tuple[int, ...]]) -> list[float]:
    """For each part, the pairs of fingerprints with the same value in it, over all fingerprints."""
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask_of(p))).alias("v")) for i, p in enumerate(parts)])
    counts = prints.select(F.explode(keys).alias("k")).groupBy("k.i", "k.v").agg(F.count("*").cast("double").alias("c"))
    rows = counts.groupBy("i").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs")).collect()  # one row a part
    found = {row.i: row.pairs for row in rows}
    return [found.get(i, 0.0) for i in range(len(parts))]


def within(differ: np.ndarray, most: int) -> float:
    """Chance that at most ``most`` of some bits differ, each with its own chance."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for d in differ:
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    return float(chance.sum())


def thresholds(n: int, both: np.ndarray, parts: list[tuple[int, ...]], pairs: list[float]) -> tuple[list[int], float]:
    """One threshold a part, adding up to RADIUS - m + 1, at the least estimated cost."""
    share = np.diag(both) / max(n, 1)
    m, need = len(parts), RADIUS - len(parts) + 1

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        differ = 2 * share[list(parts[i])] * (1 - share[list(parts[i])])
        grown = within(differ, t) / max(within(differ, 0), 1e-300)
        return KEY_COST * n * comb(len(parts[i]), t) + PAIR_COST * pairs[i] * grown

    # best[s]: cheapest thresholds of the parts so far that add up to s.
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (sofar, chosen) in best.items():
            for t in range(-1, RADIUS + 1):
                entry = (sofar + cost(i, t), [*chosen, t])
                if s + t not in step or entry < step[s + t]:
                    step[s + t] = entry
        best = step
    total, chosen = best[need]
    return chosen, total


def choose(prints: DataFrame, widths: tuple[int, ...] = (2, 3, 4)) -> list[int]:
    """Masks of the bits that make a key, for the cheapest of the ways to cut the bits."""
    n, both = bit_counts(prints)
    ways = [correlated_parts(n, both, m) for m in widths]
    flat = meeting_pairs(prints, [p for way in ways for p in way])
    options = []
    for way in ways:
        pairs, flat = flat[: len(way)], flat[len(way) :]
        chosen, total = thresholds(n, both, way, pairs)
        options.append((total, chosen, way))
    _, chosen, way = min(options)
    masks = []
    for part, t in zip(way, chosen, strict=True):
        if t == 0:
            masks.append(mask_of(part))
        elif t > 0:
            masks += [mask_of(tuple(sorted(set(part) - set(gone)))) for gone in combinations(part, t)]
    return masks


def filed(prints: DataFrame, masks: list[int]) -> DataFrame:
    """``(fp, mask, value)``: each fingerprint under the bits of each mask."""
    return prints.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))


def verified(blocks: DataFrame) -> DataFrame:
    """``(a, b)``: links inside blocks of at most BLOCK fingerprints, as few as keep what is connected so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            members = batch.column(0)
            flat = members.flatten().to_numpy(zero_copy_only=False)
            bounds = np.r_[0, np.cumsum(pa.compute.list_value_length(members).to_numpy(zero_copy_only=False))]
            for start, end in zip(bounds[:-1], bounds[1:], strict=True):
                a, b = _linked(np.sort(flat[start:end]))
                left.append(a)
                right.append(b)
            if left:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(left), "b": np.concatenate(right)})

    return blocks.mapInArrow(run, "a long, b long")


def _linked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value with the first one within RADIUS, and further links only between groups these leave apart."""
    apart = np.bitwise_count((values[:, None] ^ values[None, :]).view(np.uint64))
    i, j = np.nonzero(np.tril(apart <= RADIUS, -1))
    root = list(range(len(values)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return values[i[kept]], values[j[kept]]


def longer_masks(mask: int) -> list[int]:
    """The mask with each third of the bits it leaves free: within RADIUS, one third agrees whole."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    fixed = {b for b in range(BITS) if mask >> b & 1}
    return [mask_of(tuple(sorted(fixed | set(free[part :: RADIUS + 1])))) for part in range(RADIUS + 1)]


def links(prints: DataFrame) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that connect all that lie within RADIUS bits."""
    spark = prints.sparkSession
    rows, found = filed(prints, choose(prints)), []
    # Each round fixes a third of the free bits; from 8 free bits on no block exceeds BLOCK.
    while True:
        sizes = stored(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1"), "blocks")
        small = sizes.where(F.col("n") <= BLOCK).select("mask", "value")
        # Dealt out again after the join, which can then split a large block that it drops.
        met = rows.join(small, ["mask", "value"]).repartition("mask", "value")
        path = scratch(spark, "links")
        verified(met.groupBy("mask", "value").agg(F.collect_list("fp").alias("members")).select("members")).write.parquet(path)
        found.append(path)
        large = sizes.where(F.col("n") > BLOCK).select("mask", "value")
        masks = [row.mask for row in large.select("mask").distinct().collect()]  # a few for each mask of the first round
        if not masks:
            return spark.read.parquet(*found)
        longer = spark.createDataFrame([(mask, longer_masks(mask)) for mask in masks], "mask long, more array<long>")
        again = rows.join(large, ["mask", "value"]).join(longer, "mask").select("fp", F.explode("more").alias("mask"))
        rows = stored(again.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).distinct(), "rows")


def _labelled(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, digest, fp, group, component_id)`` of each row; a group is named by its smallest fingerprint."""
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    docs = stored(fingerprints(rows), "prints")
    prints = stored(docs.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    root = components(links(prints.select("fp"))).withColumnRenamed("node", "fp")
    named = prints.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("group"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    # Stored, so that both sides of the last join are dealt out for it and a hot fingerprint can be split.
    labels = stored(named.select("fp", "group").join(least, "group"), "labels")
    return docs.join(labels, "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, ``fingerprint`` and ``component_id``, the smallest id its links reach, its own included.

    The fingerprint is 16 hexadecimal digits. NULL and empty texts have fingerprint zero and
    are linked like any other. Repeated rows and ids stay; a NULL id is smaller than none, so
    only a group without any id has component NULL. An empty table gives an empty one. Only
    the two columns named are read, so others may have any name.
    """
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _labelled(df, id_col, text_col).select(F.col("id").alias(id_col), fingerprint.alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: Callable[[DataFrame, str, str], DataFrame] = _labelled) -> DataFrame:
    """One row of each group of near duplicates, all columns kept: that with the smallest id, NULL last.

    ``labelled`` tells the groups, as ``(id, digest, group)`` of each row; by default those of the fingerprints.
    Of texts under one id the one with the smallest hash stays; of rows equal in id and text any.
    Input columns must not be named ``_id``, ``_digest``, ``_n`` or ``__member_key``.
    """
    place = ["group", "id", "digest"]
    rows = stored(labelled(df, id_col, text_col).groupBy(*place).agg(F.count("*").alias("n")), "places")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "digest", "n")).alias("first"))
    first = stored(first.select(F.col("first.id").alias("_id"), F.col("first.digest").alias("_digest"), F.col("first.n").alias("_n")), "first")
    # Rows that no bit of a dropped or repeated one marks stay where they are; the others, few, are looked up.
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")) & (F.col("_n") == 1)
    doubtful = rows.join(first, same, "left_anti")
    table = df.sparkSession.sparkContext.broadcast(bit_table(doubtful, F.xxhash64("id", "digest")))
    key = F.xxhash64(F.col(id_col), F.xxhash64(text_col))
    alone = filtered(df, key, table, False)
    kept = filtered(df, key, table, True).join(first, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_digest")))
    several = kept.where("_n > 1").dropDuplicates(["_id", "_digest"])
    looked_up = kept.where("_n = 1").unionByName(several).select([F.col(f"`{c}`") for c in df.columns])
    return alone.unionByName(looked_up)

"""Near duplicates by the Jaccard similarity of their shingle sets, exact (near_dedup of the pipeline).

The method is that of operator 2: each set has a fingerprint of 64 bits, fingerprints within two bits are
linked through the general pigeonhole principle (``simhash.links``), and links are verified on whole sets.
Sets as similar as ``percent`` may have fingerprints further apart, so an exact search completes them.

A text's set holds the hashes of its runs of ``width`` words. Two sets of similarity ``percent``
or more share a member among the first ``n - ceil(percent * n / 100) + 1`` of each, in whatever
order all sets are sorted (prefix filtering). So:

1. sets are named by 128 bits, and one row stands for all that share a set;
2. members are sorted by how often a sample of texts holds them, rare ones first, then by hash;
   the sample changes what the search costs, never what it finds;
3. sets are filed under the members of their prefixes, which are moved once, packed; members in one
   prefix only are left out where they arrive, and sets that meet are candidates where
   their sizes and the places of the shared member allow the similarity;
4. candidates are verified on whole sets. Sets that meet are compared with one of them first,
   then with some, then with all, always leaving out those that links already connect: a large
   group of near copies is not paired as a whole, and no link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillstrata.llm import simhash
from skillstrata.llm.common import forget, pieces, stored, texts_of
from skillstrata.llm.components import components
from skillstrata.llm.membership import bit_table, may_hold

SEED = 42
PIECE_BYTES = 4 << 20
SAMPLE_TEXTS = 20_000  # or a 64th of all, if that is more
OFTEN = 1 << 20  # members whose number in the sample is kept
KEYS_AT_ONCE = 1 << 18  # packed together by a task
KEYS_OF_SLICE = 1 << 19  # on average, of a range of keys that is held together
PIVOTS = (16, 1)  # one of so many sets is compared with all it meets, round by round


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words; all words make one run where they are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) > width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64))


def set_name(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes(), SEED)


def frequent(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Members that several texts of a sample hold, sorted, and how many hold each; OFTEN at most."""
    one_of = max(1, min(64, rows.count() // SAMPLE_TEXTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE_BYTES):
            sets = [shingle_set(text, width) for text in texts_of(piece, "text")]
            yield pa.RecordBatch.from_pydict({"member": pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))})

    sample = rows.where(F.pmod("digest", F.lit(one_of)) == 0).dropDuplicates(["digest"]).select("text")
    counts = sample.mapInArrow(run, "member long").groupBy("member").agg(F.count("*").alias("n")).where("n > 1")
    found = counts.orderBy(F.col("n").desc(), "member").limit(OFTEN).toArrow()
    members, n = found["member"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(members)
    return members[order], n[order]


def numbered_as(name: bytes, salt: int) -> int:
    """A set's number, as ``numbered`` gives it, out of its name alone."""
    return xxhash.xxh64_intdigest(name + bytes([salt]), SEED)


def numbered(distinct: DataFrame) -> tuple[DataFrame, int]:
    """Sets with ``fp``, a number of 64 bits that no two share, and the salt that makes it so."""
    for salt in range(256):
        found = stored(distinct.withColumn("fp", F.xxhash64(F.concat("name", F.lit(bytes([salt]))))), "distinct")
        if found.groupBy("fp").agg(F.count("*").alias("sets")).where("sets > 1").isEmpty():
            return found, salt
        forget(found)
    raise RuntimeError("no salt gives each set a number of its own")


def prefix(members: np.ndarray, often: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The members of a set, rarest first, of which a similar set shares one."""
    known, n = often
    count = np.zeros(len(members), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, members), len(known) - 1)
        count = np.where(known[at] == members, n[at], 0)
    size = len(members) - -(-percent * len(members) // 100) + 1 if len(members) else 0
    return members[np.lexsort((members, count))][:size]


def named(rows: DataFrame, width: int) -> DataFrame:
    """``(id, digest, name, n, bits)``: each row's set by name, size and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE_BYTES):
            sets = [shingle_set(text, width) for text in texts_of(piece, "text")]
            columns = {name: piece.column(piece.schema.get_field_index(name)) for name in ("id", "digest")}
            yield pa.RecordBatch.from_pydict(
                columns | {"name": pa.array(map(set_name, sets), pa.binary()), "n": pa.array(map(len, sets), pa.int64())}
                | {"bits": pa.array(np.fromiter(map(simhash.bits_of, sets), np.uint64, len(sets)).view(np.int64))}
            )

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, digest long, name binary, n long, bits long")


def chosen_texts(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(text)`` of the rows ``chosen(id, digest)``, found where they lie: no text is moved.

    Rows that the bit table takes for chosen ones come in vain, rows chosen twice come twice.
    """
    table = rows.sparkSession.sparkContext.broadcast(bit_table(chosen, F.xxhash64("id", "digest")))

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(table.value, batch.column(0).to_numpy()))).select(["text"])

    return rows.select(F.xxhash64("id", "digest").alias("key"), "text").mapInArrow(thinned, "text string")


def shared_keys(texts: DataFrame, width: int, percent: int, often: Broadcast, salt: int, slices: int) -> DataFrame:
    """``(fp, n, at, key)``: the members that the prefixes of several sets share, with each set's size and their place in it.

    Keys move once, packed by ranges of their values, and lone ones end where they arrive: what comes
    out grows with what is shared, however many keys there are. ``slices`` grows with the keys, so a range stays small.
    """
    span = np.uint64(((1 << 64) - 1) // slices)

    def packed(found: list[tuple[np.ndarray, int, int]]) -> Iterator[pa.RecordBatch]:
        sizes = [len(keys) for keys, _, _ in found]
        keys = np.concatenate([keys for keys, _, _ in found])
        fps = np.repeat(np.array([fp for _, fp, _ in found], np.uint64), sizes)
        n = np.repeat(np.array([n for _, _, n in found], np.uint32), sizes)
        at = np.concatenate([np.arange(size, dtype=np.uint32) for size in sizes])
        order = np.argsort(keys)
        keys, fps, n, at = keys[order], fps[order], n[order], at[order]
        part = np.minimum(keys // span, np.uint64(slices - 1)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        rows = []
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            small = (pa.compress(x[a:b].tobytes(), "zstd", asbytes=True) for x in (n, at))
            rows.append((int(part[a]), int(b - a), keys[a:b].tobytes(), fps[a:b].tobytes(), *small))
        columns = dict(zip(("slice", "size", "keys", "fps", "n", "at"), map(list, zip(*rows, strict=True)), strict=True))
        yield pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for piece in pieces(batches, "text", PIECE_BYTES):
            for text in texts_of(piece, "text"):
                members = shingle_set(text, width)
                if len(members):
                    first = prefix(members, often.value, percent)
                    found.append((first, numbered_as(set_name(members), salt), len(members)))
                    held += len(first)
                if held >= KEYS_AT_ONCE:
                    yield from packed(found)
                    found, held = [], 0
        if found:
            yield from packed(found)

    def merge(table: pa.Table) -> pa.Table:
        columns = table.to_pydict()
        keys, fps = (np.concatenate([np.frombuffer(x, np.uint64) for x in columns[c]]) for c in ("keys", "fps"))
        n, at = (
            np.concatenate([np.frombuffer(pa.decompress(x, 4 * size, "zstd", asbytes=True), np.uint32) for x, size in zip(columns[c], columns["size"], strict=True)])
            for c in ("n", "at")
        )
        order = np.lexsort((fps, keys))
        keys, fps, n, at = keys[order], fps[order], n[order], at[order]
        # A set may come more than once, by rows that share it.
        once = np.r_[True, (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])]
        keys, fps, n, at = keys[once], fps[once], n[once], at[once]
        first = np.r_[True, keys[1:] != keys[:-1]]
        shared = ~(first & np.r_[first[1:], True])
        return pa.table({"fp": fps[shared].view(np.int64), "n": n[shared].astype(np.int64), "at": at[shared].astype(np.int64), "key": keys[shared].view(np.int64)})

    parts = texts.mapInArrow(run, "slice long, size long, keys binary, fps binary, n binary, at binary")
    return parts.groupBy("slice").applyInArrow(merge, "fp long, n long, at long, key long")


def sets_of(rows: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """``(name, members binary)`` for the sets of ``chosen(id, digest)``, once each, with a few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE_BYTES):
            sets = [shingle_set(text, width) for text in texts_of(piece, "text")]
            yield pa.RecordBatch.from_pydict({"name": pa.array(map(set_name, sets), pa.binary()), "members": pa.array([s.tobytes() for s in sets], pa.binary())})

    return chosen_texts(rows, chosen).mapInArrow(run, "name binary, members binary").dropDuplicates(["name"])


def verified(pairs: DataFrame, rows: DataFrame, names: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar. ``names(fp, name, id, digest)`` leads from numbers to rows.

    Only sets of the pairs are made and moved: each once for its own side, and b's once for a pair.
    """
    columns = ("fp", "name", "id", "digest")
    of = {side: names.select(*[F.col(c).alias(side if c == "fp" else f"{side}_{c}") for c in columns]) for side in "ab"}
    pairs = stored(pairs.join(of["a"], "a").join(of["b"], "b"), "pairs")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    sides = {side: sets_of(rows, pairs.select(F.col(f"{side}_id").alias("id"), F.col(f"{side}_digest").alias("digest")), width) for side in "ab"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    met = pairs.select("a", "b", "a_name", "b_name").join(sides["b"].toDF("b_name", "y"), "b_name").join(sides["a"].toDF("a_name", "x"), "a_name")
    found = stored(met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    forget(pairs)
    return found


def candidates(members: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: sets under one key as a pivot's, in another group, whose sizes and places allow the similarity."""
    other = pivots.select("key", *[F.col(c).alias(f"other_{c}") for c in ("fp", "n", "at", "group")])
    met = members.join(other, "key").where("`group` <> other_group")
    # The first key that two sets share has no shared member before it.
    shared = F.least(F.col("n") - F.col("at"), F.col("other_n") - F.col("other_at"))
    met = met.where((100 + percent) * shared >= percent * (F.col("n") + F.col("other_n")))
    return met.select(F.least("fp", "other_fp").alias("a"), F.greatest("fp", "other_fp").alias("b")).distinct()


def regrouped(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with the group each set is in by now, less those under keys of one group alone."""
    grouped = members.drop("group").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    grouped = grouped.withColumn("group", F.coalesce("root", "fp")).drop("root")
    several = grouped.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least < most").select("key")
    left = stored(grouped.join(several, "key", "left_semi"), "members")
    forget(members)
    return left


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """``(a, b)``: sets whose fingerprints are equal or linked, by way of the smallest set of each fingerprint."""
    prints = stored(distinct.groupBy("bits").agg(F.min("fp").alias("least")), "prints")
    alike = distinct.join(prints, "bits").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    found = simhash.links(prints.select(F.col("bits").alias("fp")))
    for side in "ab":
        found = found.join(prints.select(F.col("bits").alias(side), F.col("least").alias(f"set_{side}")), side)
    met = found.select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b"))
    return alike.unionByName(met).distinct()


def roots_of(rows: DataFrame, distinct: DataFrame, width: int, percent: int, often: Broadcast, salt: int) -> DataFrame:
    """``(node, root)`` of each set that has a similar one; root names all that are connected."""
    in_prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    total = distinct.agg(F.sum(in_prefix).alias("keys")).head().keys or 0
    found = shared_keys(chosen_texts(rows, distinct), width, percent, often, salt, total // KEYS_OF_SLICE + 1)
    members = stored(found.withColumn("group", F.col("fp")), "members")
    near = stored(fingerprint_links(distinct), "near")
    wanted = members.select("fp").unionByName(near.select(F.explode(F.array("a", "b")).alias("fp"))).distinct()
    names = stored(distinct.join(wanted, "fp", "left_semi").select("fp", "name", "id", "digest"), "names")
    linked = verified(near, rows, names, width, percent)
    forget(near)
    near_roots = components(linked)
    members = regrouped(members, near_roots)
    least = members.groupBy("key").agg(F.min(F.struct("fp", "n", "at", "group")).alias("first")).select("key", "first.*")
    found = linked.unionByName(verified(candidates(members, least, percent), rows, names, width, percent))
    forget(near_roots)
    roots = components(found)
    for one_of in PIVOTS:
        members = regrouped(members, roots)
        pivots = members.where(F.pmod(F.xxhash64("fp"), F.lit(one_of)) == 0)
        more = verified(candidates(members, pivots, percent), rows, names, width, percent)
        if not more.isEmpty():
            found = found.unionByName(more)
            forget(roots)
            roots = components(found)
    forget(members, names, found)
    return roots


def labelled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``(id, digest, fp, group)`` of each row: rows in one group are connected by steps of similarity
    ``percent`` or more. NULL and texts without words are alike."""
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    often = df.sparkSession.sparkContext.broadcast(frequent(rows, width))
    docs = stored(named(rows, width), "prints")
    # One row stands for all that share a set; numbers are shorter than names and follow from them.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first")
    distinct = docs.groupBy("name", "n", "bits").agg(first).select("name", "n", "bits", "first.id", "first.digest")
    distinct, salt = numbered(distinct)
    roots = roots_of(rows, distinct, width, percent, often, salt)
    # Stored, so that both sides of the last join are dealt out for it and a hot set can be split.
    group = F.coalesce("root", "fp").alias("group")
    labels = stored(distinct.select("name", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("name", "fp", group), "labels")
    forget(distinct, roots)
    return docs.select("id", "digest", "name").join(labels, "name").select("id", "digest", "fp", "group")

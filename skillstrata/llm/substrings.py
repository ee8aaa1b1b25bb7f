"""Removal of repeated word windows behind a count-min prefilter (operator 12).

A window of WINDOW words that starts earlier as well, in a document before or in the same one,
covers its words, and covered words go. Most windows of a corpus occur once, and a first pass
sets these aside cheaply:

1. Texts are dealt into units of some megabytes. Each unit counts its windows in a count-min
   sketch: DEPTH rows of cells, as many cells in a row as the corpus has bytes. It is sparse, so
   a unit sends the cells that it has, cut into slices of the sketch, about a byte for each.
2. For each slice the units' sketches are merged by addition, and each unit is told, a bit for a
   cell, where two windows or more were counted. An estimate is the least of a window's cells,
   never below its true count: a window that is estimated once occurs once.
3. Windows estimated repeated are named by 128 bits of their words. A unit finds its own repeats
   and sends the first of each name to the name's slice, where the first of all is found; each
   unit is told, a bit for a name, which of its windows start earlier elsewhere.

Texts are shuffled once, by unit; the three passes over them read the same shuffle. A window
that every document holds is sent once by a unit, so no name and no cell is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillstrata.llm.common import partitions, without

WINDOW = 20
DEPTH = 2
UNIT_BYTES = 8 << 20  # text a unit holds on average
SLICE_BITS = 23  # cells of a merged slice, a byte each while it is merged
NAMES_SLICE_BYTES = 1 << 23  # text for which one slice of names is made
PIECE_BYTES = 1 << 20

SKETCH, TOLD = "slice int, unit int, n int, cells binary, twice binary", "unit int, kind int, slice int, n int, bits binary"
NAMES = "slice int, unit int, names binary, docs binary"
ADDED = "n_words long, n_removed long, kept_text string"
FIRST_DOC = np.iinfo(np.int64).min  # of rows without an id: they come first

_odd = 0x9E3779B97F4A7C15
_letters = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([b])) for b in range(256)), "<u8")


@dataclass(frozen=True)
class Plan:
    """Sizes that follow from the corpus: units, bits of a sketch row, slices of names."""

    units: int
    row_bits: int
    name_bits: int

    @classmethod
    def of(cls, n_bytes: int, least_units: int) -> Plan:
        bits = max(n_bytes, 2).bit_length()
        return cls(max(-(-n_bytes // UNIT_BYTES), least_units), bits, max(0, bits - NAMES_SLICE_BYTES.bit_length()))

    @property
    def slice_bits(self) -> int:
        return min(SLICE_BITS, self.row_bits)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    factors = np.full((2, size), 1, np.uint64)
    factors[0, 1:], factors[1, 1:] = _odd, pow(_odd, -1, 1 << 64)
    return tuple(np.multiply.accumulate(factors, axis=1))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Texts:
    """Words of some documents in one buffer, a space between two, and where windows start."""

    def __init__(self, texts: list[str | None]) -> None:
        words = [(text or "").encode("utf-8", "surrogatepass").split() for text in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.joined = [b" ".join(w) for w in words]
        self.buffer = b" ".join(compress(self.joined, self.sizes))
        letters = np.frombuffer(self.buffer, np.uint8)
        blanks = np.flatnonzero(letters == 32)
        n = int(self.sizes.sum())
        self.starts, self.ends = (np.r_[0, blanks + 1], np.r_[blanks, len(letters)]) if n else (blanks, blanks)
        self.bounds = np.r_[0, np.cumsum(self.sizes)]
        n_windows = np.maximum(self.sizes - WINDOW + 1, 0)
        self.window_doc = np.repeat(np.arange(len(texts)), n_windows)
        # Places of windows among all words: those of a document begin at its first word.
        self.windows = np.arange(int(n_windows.sum())) + np.repeat(self.bounds[:-1] - (np.cumsum(n_windows) - n_windows), n_windows)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each window's words, from running sums over the buffer."""
        letters = np.frombuffer(self.buffer, np.uint8)
        size = 1 << len(letters).bit_length()
        powers, inverse = _powers(max(size, 1 << 21))
        sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(_letters[letters] * powers[: len(letters)], out=sums[1:])
        start, end = self.starts[self.windows], self.ends[self.windows + WINDOW - 1]
        return _mixed((sums[end] - sums[start]) * inverse[start])

    def names(self, chosen: np.ndarray) -> bytes:
        """128 bits of the words of each chosen window."""
        view, name = memoryview(self.buffer), xxhash.xxh3_128_digest
        at = self.windows[chosen]
        return b"".join(name(view[a:b]) for a, b in zip(self.starts[at].tolist(), self.ends[at + WINDOW - 1].tolist(), strict=True))


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for row, text in enumerate(texts):
        size += len(text or "")
        if size >= PIECE_BYTES:
            yield start, row + 1
            start, size = row + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Unit:
    """The documents of a unit, in order, with all their windows in that order."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, plan: Plan) -> None:
        self.plan = plan
        ids, texts = table.column(id_col).to_pylist(), table.column(text_col).to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or ""))
        self.ids = np.array([FIRST_DOC if ids[i] is None else ids[i] for i in self.order], np.int64)
        texts = [texts[i] for i in self.order]
        self.pieces = [(a, Texts(texts[a:b])) for a, b in _pieces(texts)]
        hashes = np.concatenate([np.zeros(0, np.uint64), *(p.hashes() for _, p in self.pieces)])
        shift = np.uint64(64 - plan.row_bits)
        # Cell numbers of all rows follow one another.
        self.cells = [(_mixed(hashes + np.uint64(row * _odd % (1 << 64))) >> shift) + np.uint64(row << plan.row_bits) for row in range(DEPTH)]

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Cells that hold a window, ascending, and whether they hold several."""
        cells = np.concatenate([_heads(np.sort(c)) for c in self.cells], axis=1)
        return cells[0], cells[1].astype(bool)

    def sketch(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        cells, twice = self.counted()
        for number, a, b in _runs((cells >> np.uint64(self.plan.slice_bits)).astype(np.int64)):
            yield number, b - a, packed_gaps(cells[a:b] & np.uint64((1 << self.plan.slice_bits) - 1)), np.packbits(twice[a:b]).tobytes()

    def repeated(self, told: list[tuple[int, bytes]]) -> np.ndarray:
        """Windows that the merged sketch counts twice or more, by their places in the unit."""
        cells, _ = self.counted()
        bits = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(b, np.uint8), count=n) for n, b in told)]).astype(bool)
        shared = cells[bits]
        chosen = np.arange(len(self.cells[0]))
        for row in self.cells:
            chosen = chosen[_held(shared, row[chosen])]
        return chosen

    def names(self, chosen: np.ndarray) -> np.ndarray:
        """Two columns of 64 bits for each chosen window."""
        found, before = [], 0
        for _, piece in self.pieces:
            n = len(piece.windows)
            mine = chosen[np.searchsorted(chosen, before) : np.searchsorted(chosen, before + n)] - before
            found.append(piece.names(mine))
            before += n
        return np.frombuffer(b"".join(found), ">u8").reshape(-1, 2).astype(np.uint64)

    def doc_of(self, windows: np.ndarray) -> np.ndarray:
        docs = np.concatenate([np.zeros(0, np.int64), *(a + p.window_doc for a, p in self.pieces)])
        return docs[windows]


def _heads(cells: np.ndarray) -> np.ndarray:
    """Different values of a sorted array, and 1 for those that occur again."""
    new = np.r_[True, cells[1:] != cells[:-1]] if len(cells) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return np.stack([cells[at], (np.diff(np.r_[at, len(cells)]) > 1).astype(np.uint64)])


def _held(values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
    return values[at] == asked


def _runs(numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal numbers in an ascending array: number, start, end."""
    edges = np.r_[0, np.flatnonzero(np.diff(numbers)) + 1, len(numbers)] if len(numbers) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(numbers[a]), a, b


def packed_gaps(values: np.ndarray) -> bytes:
    """An ascending array as gaps: low bytes, then what is above them, compressed."""
    gaps = np.diff(values, prepend=np.uint64(0))
    return gaps.astype(np.uint8).tobytes() + pa.compress((gaps >> np.uint64(8)).astype("<u4").tobytes(), "zstd", asbytes=True)


def unpacked_gaps(data: bytes, n: int) -> np.ndarray:
    low = np.frombuffer(data, np.uint8, n).astype(np.int64)
    high = np.frombuffer(pa.decompress(data[n:], 4 * n, "zstd", asbytes=True), "<u4").astype(np.int64)
    return np.cumsum(low | high << 8)


def named_firsts(unit: Unit, told: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated windows of a unit: first of each name by ascending name, their names, and the rest."""
    chosen = unit.repeated(told)
    names = unit.names(chosen)
    order = np.lexsort((names[:, 1], names[:, 0]))
    names = names[order]
    new = np.r_[True, np.any(names[1:] != names[:-1], axis=1)] if len(names) else np.zeros(0, bool)
    return chosen[order[new]], names[new], chosen[order[~new]]


def _name_slices(names: np.ndarray, plan: Plan) -> Iterator[tuple[int, int, int]]:
    return _runs((names[:, 0] >> np.uint64(64 - plan.name_bits)).astype(np.int64) if plan.name_bits else np.zeros(len(names), np.int64))


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    types = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({name: pa.array(column, types[kind]) for (name, kind), column in zip(fields, columns, strict=True)})


def _merge_sketches(table: pa.Table, cells: int) -> pa.Table:
    """A slice of all units' sketches added up; for each unit the bits of its cells with two or more."""
    counts = np.zeros(cells, np.uint8)
    rows = table.to_pylist()
    for again in (False, True):
        told = []
        for r in rows:
            at = unpacked_gaps(r["cells"], r["n"])
            if not again:
                more = np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=r["n"])
                counts[at] = np.minimum(counts[at] + 1 + more, 2)
            else:
                told.append((r["unit"], 0, r["slice"], r["n"], np.packbits(counts[at] >= 2).tobytes()))
    return _rows(TOLD, told)


def _merge_names(table: pa.Table) -> pa.Table:
    """For each unit the bits of its names that start earlier in another unit."""
    rows = table.to_pylist()
    names = [np.frombuffer(r["names"], "<u8").reshape(-1, 2) for r in rows]
    sizes = [len(n) for n in names]
    names = np.concatenate(names)
    docs = np.concatenate([np.frombuffer(r["docs"], "<i8") for r in rows])
    units = np.repeat([r["unit"] for r in rows], sizes)
    order = np.lexsort((units, docs, names[:, 1], names[:, 0]))
    earlier = np.empty(len(names), bool)
    earlier[order] = np.r_[False, np.all(names[order[1:]] == names[order[:-1]], axis=1)]
    ends = np.cumsum(sizes)
    return _rows(TOLD, [(r["unit"], 1, r["slice"], n, np.packbits(earlier[e - n : e]).tobytes()) for r, n, e in zip(rows, sizes, ends, strict=True)])


def _told(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    """What a unit was told, slice by slice."""
    return [(r["n"], r["bits"]) for r in sorted(table.to_pylist(), key=lambda r: r["slice"]) if r["kind"] == kind]


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its words, how many of them were removed, and the kept ones joined by one space.

    Documents are ordered by id. Rows without an id come first; rows with one id are documents
    of their own, one after another. NULL and empty texts have no words. Of repeated rows all but
    one lose their windows' words; texts below WINDOW words lose none. A text of any length is one
    unit's. An empty table gives no rows. Input columns named like added ones, or ``unit``, are
    replaced; the id and text columns must not bear such names.
    """
    spark = df.sparkSession
    added = [field.split()[0] for field in ADDED.split(", ")]
    df = without(df, *added, "unit")
    plan = Plan.of(df.agg(F.sum(F.octet_length(text_col))).head()[0] or 0, partitions(spark))
    df = df.withColumn(id_col, F.col(id_col).cast("long")).withColumn(text_col, F.col(text_col).cast("string"))
    keyed = df.withColumn("unit", F.pmod(F.xxhash64(id_col, text_col), F.lit(plan.units)).cast("int"))
    by_unit = keyed.groupBy("unit")

    def sketch(key: tuple, texts: pa.Table) -> pa.Table:
        unit = Unit(texts, id_col, text_col, plan)
        return _rows(SKETCH, [(number, key[0].as_py(), n, cells, twice) for number, n, cells, twice in unit.sketch()])

    def merged(_: tuple, table: pa.Table) -> pa.Table:
        return _merge_sketches(table, 1 << plan.slice_bits)

    flags = by_unit.applyInArrow(sketch, SKETCH).groupBy("slice").applyInArrow(merged, TOLD)

    def name(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _rows(NAMES, [])
        unit = Unit(texts, id_col, text_col, plan)
        firsts, names, _ = named_firsts(unit, _told(told, 0))
        docs = unit.ids[unit.doc_of(firsts)]
        rows = [(number, key[0].as_py(), names[a:b].astype("<u8").tobytes(), docs[a:b].tobytes()) for number, a, b in _name_slices(names, plan)]
        return _rows(NAMES, rows)

    def earlier(_: tuple, table: pa.Table) -> pa.Table:
        return _merge_names(table)

    replies = by_unit.cogroup(flags.groupBy("unit")).applyInArrow(name, NAMES).groupBy("slice").applyInArrow(earlier, TOLD)

    def keep(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        texts = texts.drop_columns(["unit"])
        unit = Unit(texts, id_col, text_col, plan)
        firsts, _, later = named_firsts(unit, _told(told, 0))
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for n, b in _told(told, 1)]
        gone = np.sort(np.r_[later, firsts[np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)]])
        n_words, n_removed, kept, before = [], [], [], 0
        for _, piece in unit.pieces:
            n = len(piece.windows)
            starts = piece.windows[gone[np.searchsorted(gone, before) : np.searchsorted(gone, before + n)] - before]
            before += n
            size = len(piece.starts)
            depth = np.bincount(starts, minlength=size + 1) - np.bincount(starts + WINDOW, minlength=size + 1)
            stays = np.cumsum(depth[:size]) == 0
            for joined, a, b in zip(piece.joined, piece.bounds[:-1].tolist(), piece.bounds[1:].tolist(), strict=True):
                left = int(stays[a:b].sum())
                n_words.append(b - a)
                n_removed.append(b - a - left)
                kept.append(joined if left == b - a else b" ".join(compress(joined.split(b" "), stays[a:b])))
        values = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        texts = texts.take(pa.array(unit.order))
        return pa.table([*texts.columns, *values], [*texts.column_names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    everything = flags.unionByName(replies).groupBy("unit")
    return by_unit.cogroup(everything).applyInArrow(keep, f"{fields}, {ADDED}")

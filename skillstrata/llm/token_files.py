"""Token ids in binary files with Elias-Fano document boundaries (operator 6).

A set of files holds shards, each of consecutive documents in ascending order of their ids:

* ``<name>.ids``: the ids of all its documents, one after another, little-endian, in 2 bytes
  each where the vocabulary allows, else in 4;
* ``<name>.doc``: the document ids, little-endian signed 64-bit integers, with a byte before
  each that is 0 for a NULL id;
* ``<name>.ef``: where documents end, as an Elias-Fano sequence: the low bits of each end
  packed side by side, the high bits in unary, and the place of every SAMPLE-th one bit, from
  which ``select`` finds any boundary. That is about 2 + log2(tokens a document) bits each.

The manifest, a Parquet table beside them, names the shards in order with their counts and the
number of ids before each; a task that fails or runs twice leaves files that no manifest names.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillstrata.llm.bpe import packed
from skillstrata.llm.common import partitions, pieces
from skillstrata.llm.word_cache import WordCache

SAMPLE = 256
SHARD_IDS = 1 << 24  # a task begins a new shard beyond so many ids
PIECE_BYTES = 4 << 20
HEADER = struct.Struct("<4sIQQQQ")  # magic, low bits, documents, ids, bytes of low part, bytes of high part
MAGIC = b"EFB1"
MANIFEST = "shard string, task int, part int, first_doc long, n_docs long, n_ids long, width int"


class EliasFano:
    """A non-decreasing sequence of whole numbers with random access."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(low_bits)) & 1
        places = (values >> low_bits) + np.arange(n)
        high = np.zeros((top >> low_bits) + n + 1, np.uint8)
        high[places] = 1
        return cls(
            n,
            low_bits,
            np.packbits(low.astype(np.uint8).ravel(), bitorder="little"),
            np.packbits(high, bitorder="little"),
            places[::SAMPLE].astype("<u4"),
        )

    def to_bytes(self, total: int) -> bytes:
        head = HEADER.pack(MAGIC, self.low_bits, self.n, total, len(self.low), len(self.high))
        return b"".join([head, self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        magic, low_bits, n, _, low_size, high_size = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a boundary file")
        body = np.frombuffer(data, np.uint8, offset=HEADER.size)
        samples = body[low_size + high_size :].view("<u4")
        return cls(n, low_bits, body[:low_size], body[low_size : low_size + high_size], samples)

    def _low(self, k: np.ndarray) -> np.ndarray:
        out = np.zeros(len(k), np.int64)
        for b in range(self.low_bits):
            at = k * self.low_bits + b
            out |= ((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << b
        return out

    def _place(self, k: int) -> int:
        """Where the k-th one bit of the high part is, from the nearest sampled place on."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        place, left = int(self.samples[k // SAMPLE]), k % SAMPLE
        at = place >> 3
        byte = int(self.high[at]) >> (place & 7) << (place & 7)
        while byte.bit_count() <= left:
            left -= byte.bit_count()
            at += 1
            byte = int(self.high[at])
        for _ in range(left):
            byte &= byte - 1
        return at * 8 + (byte & -byte).bit_length() - 1

    def select(self, k: int) -> int:
        """The k-th value."""
        return (self._place(k) - k) << self.low_bits | int(self._low(np.array([k]))[0])

    def between(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1: the places of the first and the last are selected, and what lies between is decoded."""
        if a == b:
            return np.zeros(0, np.int64)
        first, last = self._place(a), self._place(b - 1)
        begin = first >> 3
        ones = np.flatnonzero(np.unpackbits(self.high[begin : (last >> 3) + 1], bitorder="little")) + 8 * begin
        ones = ones[(ones >= first) & (ones <= last)]
        k = np.arange(a, b)
        return (ones - k) << self.low_bits | self._low(k)

    def all(self) -> np.ndarray:
        """All values."""
        return self.between(0, self.n)


@lru_cache(maxsize=1)
def word_cache(tokenizer: str) -> WordCache:
    """One for each worker process: words met in one task are known in the next."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, on which the library's threads would only wait
    return WordCache(tokenizer)


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes the texts, writes the files in ascending id order and returns the manifest.

    ``folder`` is a URI that all workers reach (file, hdfs, s3, gs); ``tokenizer`` a path they
    can open. Each document's ids end with ``end_id``. NULL ids come first; repeated ids keep
    all their rows; NULL and empty texts hold only the end. An empty table writes no shards.
    """
    spark = df.sparkSession
    ordered = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = ordered.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, part, shard = TaskContext.get().partitionId(), 0, None
        cache = word_cache(tokenizer)
        width = 2 if max(cache.size - 1, end_id) < 1 << 16 else 4
        for piece in pieces(batches, "text", PIECE_BYTES):
            ids, sizes = cache.encode(piece.column(1))
            ends = np.cumsum(sizes + 1)
            with_end = np.full(len(ids) + len(sizes), end_id, f"<u{width}")
            inner = np.ones(len(with_end), bool)
            inner[ends - 1] = False
            with_end[inner] = ids
            shard = shard or _Shard(folder, task, part, width)
            shard.add(piece.column(0), with_end, ends)
            if shard.n_ids >= SHARD_IDS:
                yield shard.close()
                part, shard = part + 1, None
        if shard:
            yield shard.close()

    found = ordered.mapInArrow(run, MANIFEST)
    found.write.parquet(f"{folder}/manifest-shards")
    shards = spark.read.parquet(f"{folder}/manifest-shards")
    # One row for about SHARD_IDS ids.
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = shards.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class _Shard:
    """Files being written."""

    def __init__(self, folder: str, task: int, part: int, width: int) -> None:
        self.fs, root = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"shard-{task:06d}-{part:04d}-{uuid.uuid4().hex}"
        self.root, self.task, self.part, self.width = root, task, part, width
        self.out = self.fs.open_output_stream(f"{root}/{self.name}.ids")
        self.docs: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.n_ids = 0

    def add(self, docs: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        self.out.write(ids.tobytes())
        row = np.zeros(len(docs), [("known", "u1"), ("id", "<i8")])
        row["known"] = docs.is_valid().to_numpy(zero_copy_only=False)
        row["id"] = docs.fill_null(0).to_numpy(zero_copy_only=False)
        self.docs.append(row)
        self.ends.append(ends + self.n_ids)
        self.n_ids += len(ids)

    def close(self) -> pa.RecordBatch:
        self.out.close()
        docs, ends = np.concatenate(self.docs), np.concatenate(self.ends)
        for kind, data in (("doc", docs.tobytes()), ("ef", EliasFano.of(ends).to_bytes(self.n_ids))):
            with self.fs.open_output_stream(f"{self.root}/{self.name}.{kind}") as out:
                out.write(data)
        first = int(docs["id"][0]) if docs["known"][0] else None
        columns = [[self.name], [self.task], [self.part], [first], [len(docs)], [self.n_ids], [self.width]]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        names = [field.split()[0] for field in MANIFEST.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


DOCS_AT_ONCE = 2048


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document, from the files the manifest names.

    ``start`` counts the ids of all documents before it; ``ids binary`` are little-endian
    unsigned 32-bit integers. A shard's ids are read a stretch of documents at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{root}/{row['shard']}"
                with fs.open_input_stream(f"{path}.ef") as file:
                    boundaries = EliasFano.from_bytes(file.read())
                with fs.open_input_stream(f"{path}.doc") as file:
                    docs = np.frombuffer(file.read(), [("known", "u1"), ("id", "<i8")])
                with fs.open_input_file(f"{path}.ids") as file:
                    for a in range(0, boundaries.n, DOCS_AT_ONCE):
                        b = min(a + DOCS_AT_ONCE, boundaries.n)
                        ends = boundaries.between(a, b)
                        starts = np.r_[boundaries.select(a - 1) if a else 0, ends[:-1]]
                        sizes = ends - starts
                        data = file.read_at(int(sizes.sum()) * row["width"], int(starts[0]) * row["width"])
                        ids = np.frombuffer(data, f"<u{row['width']}").astype("<u4")
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(docs["id"][a:b], mask=docs["known"][a:b] == 0),
                                "start": starts + row["ids_before"],
                                "n_tokens": sizes,
                                "ids": packed(ids, sizes),
                            }
                        )

    dealt = manifest.select("shard", "width", "ids_before").repartition(partitions(spark), "shard")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")

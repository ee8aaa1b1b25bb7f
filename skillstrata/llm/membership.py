"""A bit table of fixed size that tells which hashes may belong to a set.

It thins out rows before a join that decides exactly. Its size is fixed, so it can be sent to
every task; the more hashes, the more rows it lets through in vain, and nothing else changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26  # 8 MB


def bit_table(df: DataFrame, hashes: Column) -> np.ndarray:
    """The table of some 64-bit hashes: at most BITS / 64 rows, of which the driver makes BITS / 8 bytes."""
    slot = F.pmod(hashes, F.lit(BITS))
    words = df.select(F.shiftright(slot, 6).alias("word"), F.pmod(slot, F.lit(64)).cast("int").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    table = np.zeros(BITS // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint64)


def may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes.astype(np.int64) % BITS).astype(np.uint64)
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def filtered(df: DataFrame, key: Column, table: Broadcast, held: bool) -> DataFrame:
    """Rows whose hashed key a broadcast bit table holds, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__member_key")
            kept = batch.filter(pa.array(may_hold(table.value, batch.column(at).to_numpy()) == held))
            yield kept.drop_columns(["__member_key"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.withColumn("__member_key", key).mapInArrow(run, kinds)

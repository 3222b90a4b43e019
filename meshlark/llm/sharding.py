"""Reproducible shuffling into shards by a Feistel permutation of global row numbers (operator 6).

Row numbers follow ascending (doc_id, CRC-32 of the text, size), nulls last. A keyed Feistel network permutes the
smallest even power of two that holds all rows, and walks its cycle until a number below the row count comes. Position
``p`` of the shuffled order lies in shard ``p % shards`` at slot ``p // shards``, so both can be computed for any row,
backwards as well, and the shards' row counts differ by one at most (law ``rows``).

Results for special input: a null text has size 1 and CRC 0; null doc_ids are numbered last; equal rows get numbers in
any order, which no result can tell apart; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.scratch import Scratch, pick, tasks_for

ROUNDS = 6
_MASK = (1 << 64) - 1


def _round_keys(seed: int) -> list[int]:
    keys, x = [], (seed * 2 + 1) & _MASK
    for _ in range(ROUNDS):
        x = (x * 6364136223846793005 + 1442695040888963407) & _MASK
        keys.append(x | 1)
    return keys


class Feistel:
    """A permutation of ``range(n)``; ``forward`` and ``backward`` take integer arrays."""

    def __init__(self, n: int, seed: int):
        self.n = n
        self.half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
        self.low = np.uint64((1 << int(self.half)) - 1)
        self.keys = [np.uint64(k) for k in _round_keys(seed)]

    def _f(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * key
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.low

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.low
        for key in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ self._f(left, key), left
            else:
                left, right = right, left ^ self._f(right, key)
        return (left << self.half) | right

    def _walk(self, rows: np.ndarray, back: bool) -> np.ndarray:
        out = np.asarray(rows).astype(np.uint64)
        todo = np.arange(len(out))
        while len(todo):
            out[todo] = self._once(out[todo], back)
            todo = todo[out[todo] >= self.n]
        return out.astype(np.int64)

    def forward(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, back=False)

    def backward(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, back=True)


def shard(df: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, place, shard and slot for every row.

    Only ids, sizes and checksums are sorted. Each range of the sort numbers its rows from 0; the ranges' bases are
    prefix sums of their counts (a number for each range comes to the driver).
    """
    spark = df.sparkSession
    rows = pick(df, doc_id=id_col, text=text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = rows.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_last(), "text_crc32", "size"]
    ranges = tasks_for(keys, 64 << 20)
    # rows alike in all columns may hold any number, so a running id spreads them over ranges
    keys = keys.withColumn("run", F.monotonically_increasing_id()).repartitionByRange(ranges, *order, "run").sortWithinPartitions(*order, "run").drop("run")

    def number(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(k, part, np.int32)), pa.array(np.arange(n, n + k))], [*batch.schema.names, "part", "own"])
            n += k

    scratch = Scratch(spark, "sharding")
    kind = rows.schema["doc_id"].dataType.simpleString()
    numbered = scratch.write(keys.mapInArrow(number, f"doc_id {kind}, size long, text_crc32 long, part int, own long"), "numbered")
    sizes = np.zeros(ranges, np.int64)
    for r in numbered.groupBy("part").count().collect():  # a row for each range
        sizes[r["part"]] = r["count"]
    total, bases = int(sizes.sum()), np.cumsum(sizes) - sizes

    def place(batches):
        feistel = Feistel(max(total, 1), seed)
        for batch in batches:
            row = bases[batch.column("part").to_numpy()] + batch.column("own").to_numpy()
            at = feistel.forward(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array(row), pa.array(at), pa.array((at % shards).astype(np.int32)), pa.array(at // shards)], names)

    names = ["doc_id", "size", "text_crc32", "row_number", "place", "shard", "slot"]
    return numbered.mapInArrow(place, f"doc_id {kind}, size long, text_crc32 long, row_number long, place long, shard int, slot long")

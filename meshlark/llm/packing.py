"""Dense binary rows for shuffles, summed count tables, and keys that deal blobs to exact partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COUNTS = "chunk int, counts binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Non-negative integer arrays, each in its least width and by byte planes, which general compression shrinks well."""
    head, body = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        top = int(a.max()) if len(a) else 0
        width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
        head += [width, len(a)]
        body.append(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    return np.array(head, "<u4").tobytes() + b"".join(body)


def unpack(blob: bytes) -> list[np.ndarray]:
    """Arrays of unsigned 64-bit integers."""
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    head = np.frombuffer(blob, "<u4", 2 * n, 4).reshape(n, 2).tolist()
    out, at = [], 4 + 8 * n
    for width, size in head:
        planes = np.frombuffer(blob, np.uint8, width * size, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64))
        at += width * size
    return out


def zigzag(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.int64)
    return ((a << 1) ^ (a >> 63)).view(np.uint64)


def unzigzag(a: np.ndarray) -> np.ndarray:
    return (a >> np.uint64(1)).astype(np.int64) ^ -(a & np.uint64(1)).astype(np.int64)


def _murmur3(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash of an int column: MurmurHash3 (x86, 32 bits) of four bytes."""
    x = x.astype(np.uint32)
    with np.errstate(over="ignore"):
        k = x * np.uint32(0xCC9E2D51)
        k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = np.uint32(seed) ^ k
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (h ^ (h >> np.uint32(16))).view(np.int32)


def partition_keys(n: int) -> np.ndarray:
    """An int for each of ``n`` partitions that ``repartition(n, column)`` sends to just that partition."""
    keys, low = np.full(n, -1, np.int64), 0
    while (keys < 0).any():
        x = np.arange(low, low + 4 * n)
        to = _murmur3(x).astype(np.int64) % n
        found, first = np.unique(to, return_index=True)
        new = keys[found] < 0
        keys[found[new]] = x[first[new]]
        low += 4 * n
    return keys.astype(np.int32)


def count_rows(counts: np.ndarray, chunk: int) -> pa.RecordBatch:
    """A count table as rows for ``sum_counts``."""
    parts = counts.reshape(-1, chunk)
    used = np.flatnonzero(parts.any(1))
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([pack(parts[i]) for i in used], pa.binary())], ["chunk", "counts"])


def sum_counts(rows: DataFrame, size: int, chunk: int) -> np.ndarray:
    """The sum of all tasks' tables, of fixed ``size``; summed by chunk on the executors."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, blob in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = unpack(blob)[0]
                total[c] = total[c] + own if c in total else own
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pack(x) for x in total.values()], pa.binary())], ["chunk", "counts"])

    out = np.zeros((size // chunk, chunk), np.int64)
    n = min(size // chunk, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for r in rows.repartition(n, "chunk").mapInArrow(run, COUNTS).collect():  # size // chunk rows
        out[r.chunk] = unpack(bytes(r.counts))[0]
    return out.ravel()

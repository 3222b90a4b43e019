"""A compact binary form of point clouds: Morton order, deltas of the codes, varints."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC = b"MLPC"
HEAD = struct.Struct("<4sBIdddddd")


def _spread(codes: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(codes.shape[1], np.uint64)
    for b in range(bits):
        for d in range(3):
            out |= ((codes[d] >> np.uint64(b)) & np.uint64(1)) << np.uint64(3 * b + d)
    return out


def _gather(codes: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros((3, len(codes)), np.uint64)
    for b in range(bits):
        for d in range(3):
            out[d] |= ((codes >> np.uint64(3 * b + d)) & np.uint64(1)) << np.uint64(b)
    return out


def varints(values: np.ndarray) -> bytes:
    """Unsigned integers, seven bits a byte, low bits first."""
    out = np.zeros((len(values), 10), np.uint8)
    size, rest = np.ones(len(values), np.int64), values.astype(np.uint64)
    for k in range(10):
        out[:, k] = (rest & np.uint64(127)).astype(np.uint8)
        rest >>= np.uint64(7)
        more = rest > 0
        out[more, k] |= 128
        size[more] = k + 2
    return out[np.arange(10)[None, :] < size[:, None]].tobytes()


def unvarints(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    place = np.arange(len(data)) - np.repeat(begin, ends - begin + 1)
    return np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), begin) if len(ends) else np.zeros(0, np.uint64)


def encode_cloud(xyz: np.ndarray, bits: int = 16) -> tuple[bytes, np.ndarray]:
    """The payload of points (3, n) and the order in which they are stored."""
    low, span = xyz.min(1), np.maximum(xyz.max(1) - xyz.min(1), 1e-12)
    cell = np.floor((xyz - low[:, None]) / span[:, None] * ((1 << bits) - 1) + 0.5).astype(np.uint64)
    code = _spread(cell, bits)
    order = np.argsort(code, kind="stable")
    delta = np.diff(code[order], prepend=np.uint64(0))
    return HEAD.pack(MAGIC, bits, xyz.shape[1], *low, *span) + varints(delta), order


def decode_cloud(raw: bytes) -> np.ndarray:
    magic, bits, n, *box = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("no point cloud")
    code = np.cumsum(unvarints(raw[HEAD.size :]), dtype=np.uint64)
    if len(code) != n:
        raise ValueError("damaged point cloud")
    return np.array(box[:3])[:, None] + _gather(code, bits) / ((1 << bits) - 1) * np.array(box[3:])[:, None]


def pack_clouds(df: DataFrame, key: str, axes: tuple[str, str, str], bits: int = 16) -> DataFrame:
    """(key, ids, payload): each key's points in one payload, their ids in its order."""

    def one(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        raw, order = encode_cloud(pdf[list(axes)].to_numpy(float).T, bits)
        return pd.DataFrame({key: [name[0]], "ids": [pdf["id"].to_numpy()[order]], "payload": [raw]})

    return df.select(key, "id", *axes).groupBy(key).applyInPandas(one, f"{key} {df.schema[key].dataType.simpleString()}, ids array<long>, payload binary")


def unpack_clouds(df: DataFrame, key: str) -> DataFrame:
    """(key, id, x, y, z) of payloads."""

    def run(batches):
        for pdf in batches:
            for name, ids, raw in zip(pdf[key], pdf["ids"], pdf["payload"], strict=True):
                x, y, z = decode_cloud(bytes(raw))
                yield pd.DataFrame({key: name, "id": ids, "x": x, "y": y, "z": z})

    return df.select(key, "ids", F.col("payload")).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, id long, x double, y double, z double")

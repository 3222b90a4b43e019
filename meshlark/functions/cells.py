"""Grid cells, Morton codes and other bit expressions over columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("bigint")


def unit_cell(x: Column, low: float, high: float, bits: int) -> Column:
    """The cell of ``x`` on a grid of ``2**bits`` over [low, high], clamped to the grid."""
    n = 1 << bits
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((x - F.lit(float(low))) / F.lit(float(high - low)) * F.lit(n)))).cast("bigint")


def morton(cells: Sequence[Column], bits: int) -> Column:
    """Bit ``b`` of dimension ``d`` goes to place ``b * D + d``."""
    out = F.lit(0).cast("bigint")
    for b in range(bits):
        for d, c in enumerate(cells):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("bigint")), b * len(cells) + d))
    return out


def unmorton(code: Column, dimension: int, dimensions: int, bits: int) -> Column:
    out = F.lit(0).cast("bigint")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(code, b * dimensions + dimension).bitwiseAND(F.lit(1).cast("bigint")), b))
    return out


def pack(fields: Sequence[tuple[Column, int]]) -> Column:
    """Non-negative fields of so many bits each, the first lowest."""
    out, at = F.lit(0).cast("bigint"), 0
    for value, bits in fields:
        out = out.bitwiseOR(F.shiftleft(value.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")), at))
        at += bits
    return out


def unpack(word: Column, at: int, bits: int) -> Column:
    return F.shiftright(word, at).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))

"""Special functions and pair kernels as column expressions, by name where a caller chooses one."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The rational approximation of erf by Abramowitz and Stegun, formula 7.1.26 (error below 1.5e-7).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def erfc(x: Column) -> Column:
    return 1 - erf(x)


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


#: Kernels of a distance within a radius, by name.
KERNELS: dict[str, Callable[[Column, float], Column]] = {
    "rbf": lambda d, r: F.exp(-d * d / (2 * (r / 2) ** 2)),
    "wendland": lambda d, r: F.when(d < r, F.pow(1 - d / r, F.lit(4.0)) * (4 * d / r + 1)).otherwise(0.0),
    "rational": lambda d, r: 1 / (1 + d * d / (r * r)),
}


def kernel(name: str, distance: Column, radius: float) -> Column:
    if name not in KERNELS:
        raise ValueError(f"no kernel {name}; known: {', '.join(KERNELS)}")
    return KERNELS[name](distance, radius)


#: SQL functions that ``register`` makes, with their arguments and bodies.
FUNCTIONS = {
    "ml_silu": ("x DOUBLE", "x / (1 + exp(-x))"),
    "ml_wendland": ("d DOUBLE, r DOUBLE", "CASE WHEN d < r THEN power(1 - d / r, 4) * (4 * d / r + 1) ELSE 0D END"),
    "ml_band": ("x DOUBLE, low DOUBLE, high DOUBLE", "CASE WHEN x < low THEN 'low' WHEN x < high THEN 'middle' ELSE 'high' END"),
}


def register(spark: SparkSession) -> None:
    """Makes ``FUNCTIONS`` known to SQL statements of the session; their bodies are inlined into the plan."""
    for name, (arguments, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {'STRING' if name == 'ml_band' else 'DOUBLE'} RETURN {body}")


SIDE = 8


def zigzag_order() -> list[tuple[int, int]]:
    """(row, column) of an 8 x 8 block by diagonals, up on even ones and down on odd ones."""
    return sorted(((u, v) for u in range(SIDE) for v in range(SIDE)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else -p[0]))


def _dct_row(u: int) -> list[float]:
    scale = math.sqrt((1 if u == 0 else 2) / SIDE)
    return [scale * math.cos((2 * i + 1) * u * math.pi / (2 * SIDE)) for i in range(SIDE)]


def dct_zigzag(block: Column) -> Column:
    """The orthonormal 8 x 8 cosine transform of an array of 64 numbers (row by row), in zig-zag order."""
    rows = [_dct_row(u) for u in range(SIDE)]
    table = F.array(*[F.array(*[F.lit(a * b) for a in rows[u] for b in rows[v]]) for u, v in zigzag_order()])
    product = lambda basis: F.aggregate(F.zip_with(block, basis, lambda x, b: x * b), F.lit(0.0), lambda s, y: s + y)
    return F.transform(table, product)


def quantised(coefficients: Column, step: Callable[[int, int], float]) -> Column:
    """Coefficients in zig-zag order divided by their steps, rounded."""
    steps = F.array(*[F.lit(float(step(u, v))) for u, v in zigzag_order()])
    return F.zip_with(coefficients, steps, lambda c, s: F.round(c / s).cast("int"))

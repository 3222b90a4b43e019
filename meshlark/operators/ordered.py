"""Order-dependent values over whole tables without one task that sees all rows.

A table is split into ranges of the order; within a range plain windows do, and what crosses ranges is a row for each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranged(df: DataFrame, order: Sequence[str], buckets: int = 64) -> DataFrame:
    """``df`` with ``_range``, ascending with the order's first column; the bounds are approximate quantiles of it."""
    bounds = df.agg(F.percentile_approx(order[0], [i / buckets for i in range(1, buckets)], 10000)).first()[0] or []
    bounds = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<double>")
    return df.withColumn("_range", F.size(F.filter(bounds, lambda b: b < F.col(order[0]))))


def ordered_lag(df: DataFrame, order: Sequence[str], column: str, name: str, default) -> DataFrame:
    """``column`` of the row before in the whole table's order."""
    split = ranged(df, order)
    window = Window.partitionBy("_range").orderBy(*order)
    last = split.groupBy("_range").agg(F.max_by(column, F.struct(*order)).alias("_last"))
    # a row for each range: at most as many as ``ranged`` makes
    before = last.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_before"))
    out = split.join(F.broadcast(before), "_range").withColumn(name, F.coalesce(F.lag(column).over(window), F.col("_before"), F.lit(default)))
    return out.drop("_range", "_before")


def ordered_sum(df: DataFrame, order: Sequence[str], column: str, name: str) -> DataFrame:
    """The running sum of ``column`` in the whole table's order."""
    split = ranged(df, order)
    window = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = split.groupBy("_range").agg(F.sum(column).alias("_sum"))
    before = total.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return split.join(F.broadcast(before), "_range").withColumn(name, F.sum(column).over(window) + F.col("_before")).drop("_range", "_before")

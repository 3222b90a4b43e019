"""Ordered sequences for each key: embeddings, filters, segments, epochs and warping distances."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delay_embedding(df: DataFrame, key: str, order: Sequence[str], value: str, delay: int, dimensions: int) -> DataFrame:
    """Adds x0 .. x<d-1>, the value and those ``delay`` steps before; incomplete rows go."""
    window = Window.partitionBy(key).orderBy(*order)
    out = df.withColumn("x0", F.col(value))
    for d in range(1, dimensions):
        out = out.withColumn(f"x{d}", F.lag(value, d * delay).over(window))
    return out.filter(F.col(f"x{dimensions - 1}").isNotNull())


def first_difference(df: DataFrame, key: str, order: Sequence[str], value: str, name: str = "delta") -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def one_euro(df: DataFrame, key: str, order: Sequence[str], value: str, rate: float, min_cutoff: float, beta: float, d_cutoff: float = 1.0) -> DataFrame:
    """``df`` with a column ``h``: the speed-adaptive low-pass filter along each key's order.

    A task goes through its sorted rows batch by batch and carries the filter's state, so no key's history is held at
    once. A null value gives null and leaves the state as it is; an empty table gives no rows.
    """
    step = lambda cutoff: 1.0 / (1.0 + rate / (2.0 * np.pi * cutoff))
    d_share = step(d_cutoff)

    def run(batches):
        last, h, d = object(), None, 0.0
        for batch in batches:
            out = []
            for own, x in zip(batch.column(key).to_pylist(), batch.column(value).to_pylist(), strict=True):
                if own != last:
                    last, h, d = own, None, 0.0
                if x is None:
                    out.append(None)
                    continue
                if h is None:
                    h = float(x)
                else:
                    d = d_share * (x - h) * rate + (1 - d_share) * d
                    a = step(min_cutoff + beta * abs(d))
                    h = a * x + (1 - a) * h
                out.append(h)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "h"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, f"{kinds}, h double")


#: Rungs that a bitrate is chosen from, in kbit/s.
LADDER = (500, 1200, 2500, 5000, 8000, 15000)


def rung(bandwidth: Column) -> Column:
    """The highest rung within 85 % of the bandwidth, else the lowest."""
    out = F.lit(LADDER[0])
    for b in LADDER[1:]:
        out = F.when(bandwidth * 0.85 >= b, F.lit(b)).otherwise(out)
    return out


def segments(times: Column, target: float) -> Column:
    """Start times of segments over ascending times: a new one begins once 0.85 of the target has passed."""
    start = F.slice(times, 1, 1)
    rest = F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0)))
    return F.aggregate(rest, start, lambda s, t: F.when(t - F.element_at(s, -1) >= target * 0.85, F.concat(s, F.array(t))).otherwise(s))


def gop_next(before: int, bits: int, since: int, min_gop: int, max_gop: int, least_bits: int, depth: int) -> tuple[str, bool, int]:
    """The frame's type, whether it begins a group, and the frames since the last key frame."""
    since += 1
    if (bits ^ before).bit_count() >= least_bits and since >= min_gop or since >= max_gop:
        return "IDR", True, 0
    return ("B" if since % depth else "P"), False, since


def gop_step(frames: Iterable[tuple[int, int]], min_gop: int, max_gop: int, least_bits: int, depth: int) -> list[tuple[int, str, int, int]]:
    """Frame types of (index, 64-bit hash) in order: (index, type, group, frames since the last key frame)."""
    out, before, since, group, kind = [], None, 0, 0, "IDR"
    for index, bits in frames:
        if before is not None:
            kind, new, since = gop_next(before, bits, since, min_gop, max_gop, least_bits, depth)
            group += new
        out.append((index, kind, group, since))
        before = bits
    return out


def gop_decisions(df: DataFrame, key: str, order: str, bits: str, min_gop: int = 4, max_gop: int = 30, least_bits: int = 18, depth: int = 3) -> DataFrame:
    """Runs ``gop_step`` over each key's frames; a decision depends on the last accepted cut, so no window expresses it."""

    def one(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        mask = (1 << 64) - 1
        rows = gop_step(((i, int(h) & mask) for i, h in zip(range(len(pdf)), pdf[bits], strict=True)), min_gop, max_gop, least_bits, depth)
        return pd.DataFrame([(name[0], *r) for r in rows], columns=[key, "frame", "kind", "gop", "since"])

    return df.select(key, order, bits).groupBy(key).applyInPandas(one, f"{key} {df.schema[key].dataType.simpleString()}, frame long, kind string, gop long, since long")


def epoch_average(stimuli: DataFrame, samples: DataFrame, before: int, after: int, step: int) -> DataFrame:
    """Mean sample value by time bin relative to stimuli (id, t) over samples (t, value) in [t - before, t + after).

    An interval join over time buckets of the window's width: each stimulus looks into the buckets it reaches.
    """
    width = before + after
    s = stimuli.select(F.col("t").alias("t0")).withColumn("bucket", F.explode(F.sequence(F.floor((F.col("t0") - before) / width), F.floor((F.col("t0") + after) / width))))
    x = samples.withColumn("bucket", F.floor(F.col("t") / width))
    joined = s.join(x, "bucket").withColumn("d", F.col("t") - F.col("t0")).filter((F.col("d") >= -before) & (F.col("d") < after))
    return joined.groupBy(F.floor(F.col("d") / step).alias("bin")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, name: str) -> DataFrame:
    """For each left row the ``value`` of the key's latest right row at or before it: one union, one window, no pairs."""
    marked = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType))
    other = right.select(key, time, F.lit(0).alias("_side"), F.col(value).alias("_value"))
    window = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = marked.unionByName(other, allowMissingColumns=True)
    return both.withColumn(name, F.last("_value", ignorenulls=True).over(window)).filter("_side = 1").drop("_side", "_value")


def nearest(left: DataFrame, right: DataFrame, key: str, time: str, value: str, name: str) -> DataFrame:
    """For each left row the ``value`` of the key's right row nearest in time, the earlier one on ties."""
    marked = left.withColumn("_side", F.lit(1)).withColumn("_row", F.lit(None).cast(f"struct<t:{right.schema[time].dataType.simpleString()},v:{right.schema[value].dataType.simpleString()}>"))
    other = right.select(key, time, F.lit(0).alias("_side"), F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_row"))
    window = Window.partitionBy(key).orderBy(time, "_side")
    both = marked.unionByName(other, allowMissingColumns=True)
    both = both.withColumn("_a", F.last("_row", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_b", F.first("_row", ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing))).filter("_side = 1")
    later = F.col("_a").isNull() | (F.col("_b").isNotNull() & (F.col("_b.t") - F.col(time) < F.col(time) - F.col("_a.t")))
    return both.withColumn(name, F.when(later, F.col("_b.v")).otherwise(F.col("_a.v"))).drop("_side", "_row", "_a", "_b")


def sessions(df: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """Adds the number of each key's session: a new one after more than ``gap`` seconds."""
    window = Window.partitionBy(key).orderBy(time)
    new = (F.col(time) - F.lag(time).over(window) > gap).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("session", F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def band_power(df: DataFrame, key: str, order: str, value: str, rate: float, low: float, high: float) -> DataFrame:
    """Share of spectral power in a band over each key's samples, Hann-tapered."""

    def one(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(float)
        spectrum = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)))) ** 2
        at = np.fft.rfftfreq(len(x), 1 / rate)
        total = spectrum.sum()
        return pd.DataFrame([(name[0], len(x), float(spectrum[(at >= low) & (at < high)].sum() / total) if total > 0 else 0.0)], columns=[key, "n", "share"])

    return df.select(key, order, value).groupBy(key).applyInPandas(one, f"{key} {df.schema[key].dataType.simpleString()}, n long, share double")


def dtw(a: Sequence[float], b: Sequence[float]) -> float:
    """Dynamic time warping distance with absolute differences, one anti-diagonal of the table at a time."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    n, m = len(a), len(b)
    older, old = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    older[0] = 0.0
    for k in range(2, n + m + 1):
        i = np.arange(max(1, k - m), min(n, k - 1) + 1)
        new = np.full(n + 1, np.inf)
        new[i] = np.abs(a[i - 1] - b[k - i - 1]) + np.minimum(np.minimum(old[i - 1], old[i]), older[i - 1])
        older, old = old, new
    return float(old[n]) if n and m else (0.0 if n == m else float("inf"))


def dtw_distances(df: DataFrame, key: str, order: str, value: str, reference: str | int) -> DataFrame:
    """Distance of each key's series from the reference key's: the reference is joined once, as one array."""
    arrays = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("double")).alias("xs"))
    base = arrays.filter(F.col(key) == reference).select(F.col("xs").alias("ys"))

    def each(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([dtw(x, y) for x, y in zip(xs, ys, strict=True)])

    distance = F.pandas_udf(each, "double")
    return arrays.crossJoin(F.broadcast(base)).select(key, F.size("xs").alias("n"), distance("xs", "ys").alias("distance"))  # one reference row


def latest_window(rows: DataFrame, key: str, time: str, seconds: float) -> DataFrame:
    """Each key's rows of the last ``seconds`` up to its latest time; rows of a null time are in none."""
    last = rows.groupBy(key).agg(F.max(time).alias("_last"))
    return rows.join(last, key).filter(F.col(time) > F.col("_last") - F.lit(seconds)).drop("_last")

"""Frequency and membership sketches as tables of hashed slots, with hashes that any engine repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.operators.spatial import tiled_pairs

PRIME = 1000003
#: (factor, shift) of each row's hash.
HASHES = [(7919, 104729), (15485863, 32452843), (49979687, 67867967)]


def slots(key: Column, width: int, hashes: Sequence[tuple[int, int]] = HASHES) -> list[Column]:
    return [F.pmod(F.pmod(key.cast("bigint"), F.lit(PRIME)) * (a % PRIME) + b, F.lit(PRIME)) % width for a, b in hashes]


def count_min(items: DataFrame, key: str, width: int) -> DataFrame:
    """(row, slot, n): the sketch, mergeable by sums; its size is rows times width."""
    cells = F.array(*[F.struct(F.lit(r).alias("row"), s.alias("slot")) for r, s in enumerate(slots(F.col(key), width))])
    return items.select(F.explode(cells).alias("c")).groupBy("c.row", "c.slot").agg(F.count("*").alias("n"))


def estimate(sketch: DataFrame, probes: DataFrame, key: str, width: int) -> DataFrame:
    """(key, estimate): the least of a key's slots, never below its count."""
    cells = F.array(*[F.struct(F.lit(r).alias("row"), s.alias("slot")) for r, s in enumerate(slots(F.col(key), width))])
    asked = probes.select(key, F.explode(cells).alias("c")).select(key, "c.row", "c.slot")
    return asked.join(sketch, ["row", "slot"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def bloom(items: DataFrame, key: str, width: int) -> DataFrame:
    """(word, bits): the filter's set bits, 32 in each word."""
    each = items.select(F.explode(F.array(*slots(F.col(key), width))).alias("s")).distinct()
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("s") % 32).cast("int"))
    return each.groupBy(F.floor(F.col("s") / 32).alias("word")).agg(F.bit_or(bit).alias("bits"))


def contained(filter_: DataFrame, probes: DataFrame, key: str, width: int) -> DataFrame:
    """(key, maybe): false only for keys that the filter's items lack."""
    asked = probes.select(key, F.explode(F.array(*slots(F.col(key), width))).alias("s")).withColumn("word", F.floor(F.col("s") / 32))
    hit = F.call_function("shiftright", F.coalesce("bits", F.lit(0).cast("bigint")), (F.col("s") % 32).cast("int")).bitwiseAND(1)
    return asked.join(filter_, "word", "left").groupBy(key).agg((F.min(hit) == 1).alias("maybe"))


def bottom_jaccard(rows: DataFrame, group: str, hashed: str, k: int) -> DataFrame:
    """(a, b, jaccard) for pairs of groups a < b that share one of their ``k`` least hashes: the share of the union's ``k`` least that both hold.

    Pairs without a common hash have the estimate 0 and are given too; groups are as few as sets, each a row of ``k`` hashes.
    """
    least = rows.select(F.col(group).alias("g"), F.col(hashed).alias("h")).dropna().distinct()
    least = least.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h"))).filter(F.col("r") <= k)
    sets = least.groupBy("g").agg(F.collect_list("h").alias("hashes"))
    one, two = sets.select(F.col("g").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("g").alias("b"), F.col("hashes").alias("y"))
    pairs = tiled_pairs(one, two, 4, "a", "b").filter(F.col("a") < F.col("b"))
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, k)
    both = F.array_intersect(F.array_intersect("x", "y"), union)
    return pairs.select("a", "b", (F.size(both) / F.size(union)).alias("jaccard"))

"""Mixing sources to target weights by a min-cost flow over membership patterns (operator 7).

Documents are aggregated by the set of sources that they belong to (their pattern). Word capacity flows from patterns
to the sources' quotas; the r-th use of a pattern's words costs the more the larger r is, so repetition is spread as
evenly as the quotas allow. The flow over the aggregated graph is solved on the driver: its size is the number of
distinct patterns and sources, not of documents, and is checked before anything comes to the driver. A pattern's copies
lie on a line, round after round, each round in the order of a seeded hash; its routes cut the line one after the other,
so every copy belongs to the source whose quota it fills. Cuts within a round are hash thresholds, found from histograms.

Results for special input: a null or empty text has size 0, so nothing is taken of it; a null source is a source of its
own, last in order; repeated rows share a hash and are taken alike; an empty table gives no rows; further columns are
ignored; sizes are counts over whole texts.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlark.llm.scratch import Scratch, by_place, pick, place_of
from meshlark.llm.words import scan

#: Uses of one document at most.
MOST_USES = 3
#: Patterns that the flow is solved for at most; more raise an error.
MOST_PATTERNS = 1 << 16
#: A histogram level splits hashes into this many ranges; three levels tell 2**36 hashes apart.
LEVEL_BITS, LEVELS = 12, 3


def count_words(column: pa.Array) -> pa.Array:
    """Words of each text; 0 for null."""
    found = [words.counts for _, _, words in scan(column)]
    return pa.array(np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64))


count_words_udf = F.arrow_udf(count_words, T.LongType())


def fill_targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = MOST_USES) -> list[float]:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess reshared among the others by weight."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in full:
            target[i] = float(most * sizes[i])
        left -= sum(target[i] for i in full)
        open_ -= set(full)
    return target


def min_cost_flow(patterns: Sequence[frozenset], capacity: Sequence[int], quota: Mapping, uses: int = MOST_USES) -> dict[tuple[int, object], int]:
    """Words routed from each pattern to each of its sources: successive shortest paths with potentials.

    Nodes: start, patterns, sources, end. From the start to a pattern goes an arc for each use, of its capacity and of
    cost 1, 3, 5 ... (the steps of a square); a source's arc to the end has its quota.
    """
    sources = sorted(quota, key=repr)
    n = 2 + len(patterns) + len(sources)
    start, end, place = 0, n - 1, {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    arcs: list[list[int]] = [[] for _ in range(n)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, most: int, price: int) -> int:
        for x, y, m, p in ((a, b, most, price), (b, a, 0, -price)):
            arcs[x].append(len(to))
            to.append(y), room.append(m), cost.append(p)
        return len(to) - 2

    routes = {}
    for i, pattern in enumerate(patterns):
        for r in range(uses):
            arc(start, 1 + i, int(capacity[i]), 2 * r + 1)
        for s in sorted(pattern, key=repr):
            if s in place:
                routes[i, s] = arc(1 + i, place[s], int(capacity[i]) * uses, 0)
    for s in sources:
        arc(place[s], end, int(round(quota[s])), 0)
    potential = [0] * n
    while True:
        distance, via = [float("inf")] * n, [-1] * n
        distance[start], heap = 0, [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > distance[a]:
                continue
            for k in arcs[a]:
                if room[k] > 0 and (new := d + cost[k] + potential[a] - potential[to[k]]) < distance[to[k]]:
                    distance[to[k]], via[to[k]] = new, k
                    heapq.heappush(heap, (new, to[k]))
        if via[end] < 0:
            return {key: room[k ^ 1] for key, k in routes.items() if room[k ^ 1]}
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, distance, strict=True)]
        push, a = float("inf"), end
        while a != start:
            push, a = min(push, room[via[a]]), to[via[a] ^ 1]
        a = end
        while a != start:
            room[via[a]] -= push
            room[via[a] ^ 1] += push
            a = to[via[a] ^ 1]


def _pattern_key(sources):
    """A text for a set of sources that keeps null and every name apart."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(sources)), lambda s: F.concat(F.length(s).cast("string"), F.lit(":"), s)), "|", "0")


def _drawn(rows: DataFrame, seed: int) -> DataFrame:
    """(doc_id, text, source) with sources, pattern, size, text_hash and draw; nulls in an array stand for the null source."""
    many = rows.schema["source"].dataType.typeName() == "array"
    sources = F.coalesce("source", F.array(F.lit(None).cast("string"))) if many else F.array("source")
    out = rows.withColumn("sources", F.array_sort(F.array_distinct(sources))).withColumn("pattern", _pattern_key(F.col("sources")))
    out = out.withColumn("size", count_words_udf("text")).withColumn("text_hash", F.xxhash64("text"))
    return out.withColumn("draw", F.xxhash64("doc_id", "text_hash", F.lit(seed)).bitwiseAND((1 << (LEVEL_BITS * LEVELS)) - 1))


ROUTES = "pattern string, source_size long, target double, routes array<struct<source:string,from_use:int,from_draw:long,to_use:int,to_draw:long>>"


def _routed(uses: int = MOST_USES):
    """For each route of a document's pattern how many of the document's copies it takes."""

    def copies(route):
        on = lambda use: ((use > route["from_use"]) | ((use == route["from_use"]) & (F.col("draw") >= route["from_draw"]))) & ((use < route["to_use"]) | ((use == route["to_use"]) & (F.col("draw") < route["to_draw"])))
        return sum((on(F.lit(use)).cast("int") for use in range(1, uses)), on(F.lit(0)).cast("int"))

    taken = F.transform("routes", lambda r: F.struct(r["source"].alias("source"), F.when(F.col("size") > 0, copies(r)).otherwise(F.lit(0)).alias("copies")))
    return F.filter(taken, lambda r: r["copies"] > 0)


def _copies():
    return F.aggregate("routed", F.lit(0), lambda n, r: n + r["copies"])


def _plan(sized: DataFrame, weight_of) -> DataFrame:
    """A row for each pattern: its routes, source_size, target. A route takes copies (use, draw) from one point to another."""
    spark = sized.sparkSession
    groups = sized.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(groups) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources: the flow is solved on the driver")
    groups.sort(key=lambda g: g.pattern)
    names = sorted({s for g in groups for s in g.sources}, key=lambda s: (s is None, s or ""))
    size_of = {s: sum(g["size"] for g in groups if s in g.sources) for s in names}
    total = sum(g["size"] for g in groups)
    target = dict(zip(names, fill_targets([size_of[s] for s in names], weight_of(names), total), strict=True))
    flow = min_cost_flow([frozenset(g.sources) for g in groups], [g["size"] for g in groups], target)
    cuts: dict[int, list] = {}  # of each pattern (source, where its route ends on the line of words)
    for (i, s), words in sorted(flow.items(), key=lambda x: (x[0][0], names.index(x[0][1]))):
        line = cuts.setdefault(i, [])
        line.append((s, (line[-1][1] if line else 0) + words))
    inside = {(groups[i].pattern, k): end % groups[i]["size"] for i, line in cuts.items() for k, (_, end) in enumerate(line) if end % groups[i]["size"]}
    below = _thresholds(sized, inside)
    plan = []
    for i, g in enumerate(groups):
        routes, at = [], (0, 0)
        for k, (s, end) in enumerate(cuts.get(i, [])):
            to = (end // g["size"], below.get((g.pattern, k), 0))
            routes.append((s, *at, *to))
            at = to
        plan.append((g.pattern, sum(size_of[s] for s in g.sources), float(sum(target[s] for s in g.sources)), routes))
    return spark.createDataFrame(plan, ROUTES)


def mix(df: DataFrame, weight_of, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Decides how often each document is used, and for which of its sources.

    ``source_col`` holds a source or an array of the sources a document belongs to. ``weight_of`` gets all sources in
    code point order, null last, and returns their weights. The sources share as many words as the table has.
    Returns doc_id, text_hash, size, sources, source_size, target (sums over the document's sources), routed (an array
    of source and copies, for sources that take any), copies, taken.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    sized = _drawn(pick(df, doc_id=id_col, text=text_col, source=source_col), seed)
    sized = scratch.write(sized.drop("text", "source"), "sized")
    out = sized.join(F.broadcast(_plan(sized, weight_of)), "pattern").withColumn("routed", _routed()).withColumn("copies", _copies())  # at most MOST_PATTERNS rows
    return out.select("doc_id", "text_hash", "size", "sources", "source_size", "target", "routed", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeat(df: DataFrame, weight_of, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: each row of ``df`` as often as ``mix`` decides, with all its columns; texts are not shuffled."""
    scratch = Scratch(df.sparkSession, "mixing")
    rows = pick(df, doc_id=id_col, text=text_col, source=source_col)
    sized = scratch.write(_drawn(rows, seed).drop("text", "source"), "sized")
    plan = _plan(sized, weight_of)
    flat = by_place(df)
    at = {c: place_of(df, old) for c, old in (("doc_id", id_col), ("text", text_col), ("source", source_col))}
    drawn = _drawn(flat.select(*flat.columns, *[F.col(old).alias(c) for c, old in at.items()]), seed)
    used = drawn.join(F.broadcast(plan), "pattern").withColumn("routed", _routed()).withColumn("copies", _copies())
    used = used.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies")))).filter("_copy > 0")
    return used.select(*[F.col(f"_in{i}").alias(n) for i, n in enumerate(df.columns)])


def _thresholds(sized: DataFrame, inside: dict[tuple[str, int], int]) -> dict[tuple[str, int], int]:
    """For each (pattern, cut) the hash below which documents have as near the wanted words as whole documents allow."""
    low, left, answer = dict.fromkeys(inside, 0), dict(inside), {}
    spark = sized.sparkSession
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        if not low:
            break
        table = spark.createDataFrame([(*key, at, left[key]) for key, at in sorted(low.items())], "pattern string, cut int, low long, left long")
        in_range = F.shiftright("draw", shift + LEVEL_BITS) == F.col("low")
        bins = sized.join(F.broadcast(table), "pattern").filter(in_range).groupBy("pattern", "cut", F.shiftright("draw", shift).alias("bin")).agg(F.sum("size").alias("size"), F.first("left").alias("left"))
        upto = F.sum("size").over(Window.partitionBy("pattern", "cut").orderBy("bin"))  # 2**LEVEL_BITS bins at most
        over = bins.withColumn("upto", upto).filter("upto > left").groupBy("pattern", "cut").agg(F.min_by(F.struct("bin", "size", "upto"), "bin").alias("x"))
        found = {(r.pattern, r.cut): r.x for r in over.collect()}  # a row for each cut
        for key in list(low):
            if key not in found:
                answer[key] = (low.pop(key) + 1) << (shift + LEVEL_BITS)
                continue
            at, size, upto_ = found[key]
            left[key] -= upto_ - size
            if level == LEVELS - 1:
                answer[key] = at + (1 if size - left[key] < left[key] else 0)
                low.pop(key)
            else:
                low[key] = at
    return answer


def cyclic_weights(names: Sequence, weights: Sequence[float] = (1, 2, 3)) -> list[float]:
    return [weights[i % len(weights)] for i in range(len(names))]

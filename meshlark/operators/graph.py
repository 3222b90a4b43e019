"""Components, forests, shortest paths and PageRank as joins and aggregates repeated to a fixed point.

Components start from stars that each task makes of its own edges; then the number of rounds grows with the logarithm of
their number. Null ids and repeated edges change nothing; an empty table of edges leaves every node alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.session import stage, workspace


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, w) with every edge in both directions."""
    return edges.select("src", "dst", "w").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def local_labels(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (id, least id of its component in these edges), without the least ids themselves."""
    ids, ends = np.unique(np.stack([src, dst]), return_inverse=True)
    ends = ends.reshape(2, -1)
    label = np.arange(len(ids))
    while (label[ends[0]] != label[ends[1]]).any():
        low = label[ends].min(0)
        for side in ends:  # hook each end's label under the lower one, then follow the hooks down
            np.minimum.at(label, label[side], low)
        while (label != label[label]).any():
            label = label[label]
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[other], ids[label[other]]


def _reduced(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) of long ids replaced, task by task, by stars that join the same ids."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            src, dst = local_labels(table.column("src").to_numpy(), table.column("dst").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return edges.mapInArrow(run, "src long, dst long")


#: A node with more than this share of a task's even part of the edges has its label broadcast; there are at most 4 such nodes a task.
HUB_SHARE = 4


def _relabelled(edges: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``edges`` with the ``label`` of their src; ``labels`` has src, label and the number of src's edges."""
    hubs = F.broadcast(labels.filter(F.col("held") > most).select("src", "label"))  # few, by the choice of ``most``
    rest = edges.join(hubs, "src", "left_anti").join(labels.filter(F.col("held") <= most).select("src", "label").hint("merge"), "src")
    return edges.join(hubs, "src").union(rest)


def star_labels(edges: DataFrame) -> DataFrame:
    """(id, component) for all ids that an edge (src, dst) of long ids joins to another one; alternating large and small stars."""
    folder, n = workspace(edges.sparkSession, "stars"), 0
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stars = stage(_reduced(edges.filter("src != dst")), f"{folder}/0")
    size, before = stars.count(), None
    while size and before != (before := stars.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()):
        most = max(16, 2 * before[0] // (HUB_SHARE * tasks))
        both = stars.union(stars.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("label"), F.count("*").alias("held"))
        large = _relabelled(both.filter("dst > src"), least, most).select(F.col("dst").alias("src"), F.col("label").alias("dst")).filter("src != dst").distinct()
        n += 1
        large = stage(large, f"{folder}/{n}-large")
        low = large.groupBy("src").agg(F.min("dst").alias("label"), F.count("*").alias("held"))
        lower = _relabelled(large, low, most).filter("dst != label").select(F.col("dst").alias("src"), F.col("label").alias("dst"))
        stars = stage(lower.union(low.select("src", F.col("label").alias("dst"))).distinct(), f"{folder}/{n}")
    return stars.select(F.col("src").alias("id"), F.col("dst").alias("component"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least integer id reachable over edges (src, dst), for every id of ``nodes``."""
    kind = nodes.schema["id"].dataType
    found = star_labels(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))
    labelled = nodes.select("id").distinct().join(found.select(F.col("id").cast(kind).alias("id"), F.col("component").cast(kind).alias("component")), "id", "left")
    return labelled.select("id", F.coalesce("component", "id").alias("component"))


def spanning_forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (src, dst, w) of a minimum spanning forest: each round every component takes its least edge, ties by ids, and contracts."""
    folder, n = workspace(nodes.sparkSession, "forest"), 0
    ordered = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").filter("src != dst").groupBy("src", "dst").agg(F.min("w").alias("w"))
    cross = stage(ordered.select(F.col("src").cast("long").alias("ca"), F.col("dst").cast("long").alias("cb"), F.struct("w", "src", "dst").alias("e")), f"{folder}/0")
    chosen = ordered.limit(0)
    while not cross.isEmpty():
        n += 1
        each = cross.union(cross.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), "e"))
        best = stage(each.groupBy("ca").agg(F.min_by(F.struct("cb", "e"), "e").alias("x")).select("ca", "x.cb", "x.e"), f"{folder}/{n}-best")
        chosen = chosen.union(best.select("e.src", "e.dst", "e.w").distinct())
        label = stage(star_labels(best.select(F.col("ca").alias("src"), F.col("cb").alias("dst"))), f"{folder}/{n}-labels")
        for side in ("ca", "cb"):
            cross = cross.join(label.select(F.col("id").alias(side), "component"), side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
        ends = [F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")]
        cross = stage(cross.filter("ca != cb").groupBy(*ends).agg(F.min("e").alias("e")), f"{folder}/{n}")
    return chosen


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, dist) over directed edges (src, dst, w >= 0) from each source id, relaxed until nothing shortens."""
    folder, n = workspace(edges.sparkSession, "graph"), 0
    links = stage(edges.groupBy("src", "dst").agg(F.min("w").alias("w")), f"{folder}/edges")
    best = stage(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist")), f"{folder}/0")
    front = best
    while True:
        step = front.join(links, front.id == links.src).groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        shorter = step.join(best, ["source", "id"], "left").filter("dist is null or new < dist").select("source", "id", F.col("new").alias("dist"))
        n += 1
        front = stage(shorter, f"{folder}/f{n}")
        if front.isEmpty():
            return best
        best = stage(best.union(front).groupBy("source", "id").agg(F.min("dist").alias("dist")), f"{folder}/{n}")


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float, rounds: int) -> DataFrame:
    """(id, rank) of an undirected weighted graph after ``rounds`` of p = alpha s + (1 - alpha) A D^-1 p; sums to 1."""
    links = both_ways(edges).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    degree = links.groupBy("src").agg(F.sum("w").alias("degree"))
    moves = stage(links.join(degree, "src").select("src", "dst", (F.col("w") / F.col("degree")).alias("share")), f"{workspace(edges.sparkSession, "graph")}/moves")
    total = seeds.agg(F.sum("s")).first()[0]
    start = seeds.select("id", (F.col("s") / F.lit(total)).alias("s"))
    rank = start.select("id", F.col("s").alias("rank"))
    for _ in range(rounds):
        flow = rank.join(moves, rank.id == moves.src).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share") * (1 - alpha)).alias("flow"))
        rank = flow.join(start, "id", "full").select("id", (F.coalesce("flow", F.lit(0.0)) + alpha * F.coalesce("s", F.lit(0.0))).alias("rank"))
    all_ = rank.agg(F.sum("rank").alias("all"))
    return rank.join(F.broadcast(all_)).select("id", (F.col("rank") / F.col("all")).alias("rank"))  # one row


def cascade(edges: DataFrame, start: DataFrame, depth: int, damping: float) -> DataFrame:
    """(id, effect): sum over walks of at most ``depth`` edges from (id, x), each step damped; fixed depth."""
    level = start.select("id", F.col("x").cast("double").alias("x"))
    total = level
    for _ in range(depth):
        level = level.join(edges, level.id == edges.src).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("w") * damping).alias("x"))
        total = total.union(level)
    return total.groupBy("id").agg(F.sum("x").alias("effect"))

"""Connected components of an edge table by alternating large-star and small-star steps.

Each task first reduces its own edges to stars by union-find. A step then needs the least neighbour of each node (an
aggregate with partial sums before the shuffle) and a join that hands it to the node's edges. Nodes that hold more than
``FEW`` edges and a quarter of a task's even share of them are hubs: at most ``HUBS`` a task can exist, so their least
neighbours are broadcast and their edges stay where they are; all other edges are merged by node, none of which is large.

Results for special input: edges with a null end and edges from a node to itself join nothing and name no node; repeated
edges and both directions of one count once; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.scratch import Scratch, pick

EDGES = "a long, b long"
#: Hubs for each task of a join, at most.
HUBS = 4
#: Rows that a key may have without being a hub (of 16 bytes each), however few rows there are.
FEW = 1 << 16


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of these edges that are not least themselves."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _local(batches):
    own = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if own:
        a, b = forest(*(np.concatenate(x) for x in zip(*own, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def hub_join(rows: DataFrame, table: DataFrame, key: str, count: int) -> DataFrame:
    """``rows`` (``count`` of them) joined with ``table`` (key, other columns, and the number ``n`` of the key's rows).

    Rows of hubs stay where they are; at most ``HUBS`` keys a task can be hubs.
    """
    most = max(FEW, count // (HUBS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if count <= most:
        return rows.join(table.drop("n"), key)
    hubs = F.broadcast(table.filter(F.col("n") > most).drop("n"))  # few rows, by the choice of ``most``
    others = table.filter(F.col("n") <= most).drop("n")
    return rows.join(hubs, key).union(rows.join(hubs.select(key), key, "left_anti").hint("merge").join(others, key))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge; edges hold longs a and b."""
    stars = scratch.write(pick(edges, a="a", b="b").filter("a != b").mapInArrow(_local, EDGES), "stars")
    seen, count = None, stars.count()
    while count:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = hub_join(both.filter("b > a"), least, "a", 2 * count).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = scratch.write(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        # every edge of large leads down; each node's other lower neighbours get its least one
        small = hub_join(large, least, "a", 2 * count)
        down = small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.write(down.union(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        scratch.drop(stars, large)
        stars, count = new, state[0]
        if state == seen:
            break
        seen = state
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())

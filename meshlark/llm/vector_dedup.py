"""Near-duplicate vectors by sorted projection passes (operator 5).

Equal vectors of one label are one class from the start. Each pass hashes every class by the signs of 63 random
projections, orders a label's classes by the concatenated signs and compares each with its neighbours in that order.
The number of passes follows from the size of the largest label as if signs halved it. Each pass then measures, for each
class, how many signs a prefix needs until a window holds all that share it; a pair at the threshold shares such a prefix
with a known chance. Classes whose chances over the passes leave more than ``MISS`` to miss a pair (those in clusters) are
compared with all others of that kind in their label, in blocks: a pair with either end outside them is met in a window
but for ``MISS``. Pairs found are verified by their cosine; a window or block yields a spanning forest of its links, not
all pairs. The union gives components, and the direct links of each vector are counted exactly within its component, in
blocks of pairs dealt over tasks. The blocks' work grows with the square of a label's clustered classes.

Results for special input: vectors that are null, zero or hold null or non-finite components, and vectors without a
label, link with nothing and are components of their own; only vectors of equal length are compared; a null vec_id never
names a component unless it is alone, and is not kept; repeated rows link with one another; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.components import components, forest
from meshlark.llm.scratch import Scratch, in_block_pairs, pick, tasks_for

THRESHOLD = 0.98
BITS = 63
#: Neighbours before a block of the order that the block is compared with, and rows of a block.
WINDOW, BLOCK = 128, 256
MISS = 1e-5
#: Vectors of a block when links are counted, while a component has few blocks.
COUNT_BLOCK = 32
#: Vectors of a block of clustered classes while there are few blocks, and rows compared with a block at once.
DENSE_BLOCK, ROWS = 1024, 256


def passes_for(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold has shared a window but for a chance of ``miss``, if signs halve the label."""
    same_sign = 1 - math.acos(threshold) / math.pi
    shared = same_sign ** max(1.0, math.log2(max(2, n) / WINDOW) + 2)
    return max(2, math.ceil(math.log(miss) / math.log(1 - shared)))


def prefix_bits(keys: np.ndarray, open_first: bool, open_last: bool) -> np.ndarray:
    """Signs that a prefix of each ascending key needs until at most a window's rows share it; BITS + 1 if none does.

    Where rows may go on before the first or after the last, a prefix must not be shared with that row either.
    """
    n = len(keys)
    common = lambda x: BITS - np.frexp((x & ~(x >> 1)).astype(np.float64))[1]  # noqa: E731; the next bit cleared, so no rounding up
    same = lambda a, b: np.minimum(common(a ^ b), BITS)
    need = np.zeros(n, np.int64)
    if n > WINDOW:
        spans = np.pad(same(keys[:-WINDOW], keys[WINDOW:]) + 1, WINDOW)
        need = np.lib.stride_tricks.sliding_window_view(spans, WINDOW + 1).max(1)
    for is_open, edge in ((open_first, 0), (open_last, -1)):
        if is_open and n:
            need = np.maximum(need, same(keys, keys[edge]) + 1)
    return need


def miss_logs(need: np.ndarray, threshold: float) -> np.ndarray:
    """Logarithm of the chance that one pass does not bring a pair at the threshold into a window."""
    shared = (1 - math.acos(threshold) / math.pi) ** need.astype(np.float64)
    return np.log(np.maximum(1 - np.where(need > BITS, 0.0, shared), 1e-300))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length, in double precision and of unit length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return flat / np.sqrt((flat * flat).sum(1))[:, None]


def _planes(seed: int, n_pass: int, size: int) -> np.ndarray:
    return np.random.default_rng([seed, n_pass, size]).standard_normal((size, BITS))


def _keyed(classes: DataFrame, passes: int, seed: int) -> DataFrame:
    powers = (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))

    def run(batches):
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                unit = _matrix(part.column("vector"))
                for p in range(passes):
                    keys = ((unit @ _planes(seed, p, size) > 0) * powers).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), p, np.int32)), part.column("label"), part.column("size"), pa.array(keys), part.column("node"), part.column("vector")], names)

    names = ["pass", "label", "size", "key", "node", "vector"]
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    return classes.select("label", "size", "node", "vector").mapInArrow(run, f"pass int, label {kinds['label']}, size int, key long, node long, vector {kinds['vector']}")


def _windows(keyed: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between nodes near each other in the order, as forests of the windows; (a, miss) for every node and pass."""

    def links(unit: np.ndarray, node: np.ndarray, old: int):
        for i in range(old, len(node), BLOCK):
            low, high = max(0, i - WINDOW), min(len(node), i + BLOCK)
            near = unit[i:high] @ unit[low:high].T >= threshold
            x, y = np.nonzero(near)
            x, y = node[i + x], node[low + y]
            apart = x != y
            if apart.any():
                a, b = forest(x[apart], y[apart])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.float64())], ["a", "b", "miss"])

    def run(batches):
        tail, groups = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = batch.column("label").dictionary_encode()
            group = np.stack([batch.column("pass").to_numpy(), labels.indices.to_numpy(), batch.column("size").to_numpy()])
            cut = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                part = batch.slice(i, j - i)
                name = (part.column("pass")[0], part.column("label")[0], part.column("size")[0])
                unit, node, old = _matrix(part.column("vector")), part.column("node").to_numpy(), 0
                if not groups or groups[-1][0] != name:
                    groups.append((name, [], []))
                groups[-1][1].append(part.column("key").to_numpy().copy())
                groups[-1][2].append(node.copy())
                if tail and tail[0] == name:
                    old = len(tail[2])
                    unit, node = np.concatenate([tail[1], unit]), np.concatenate([tail[2], node])
                yield from links(unit, node, old)
                tail = (name, unit[-WINDOW:].copy(), node[-WINDOW:].copy())
        for i, (_, keys, nodes) in enumerate(groups):  # the first and the last group may go on in other tasks
            miss = miss_logs(prefix_bits(np.concatenate(keys), i == 0, i == len(groups) - 1), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.nulls(len(miss), pa.int64()), pa.array(miss)], ["a", "b", "miss"])

    order = ["pass", "label", "size", "key", "node"]
    keyed = keyed.repartitionByRange(tasks_for(keyed, 64 << 20), *order).sortWithinPartitions(*order)
    return keyed.mapInArrow(run, "a long, b long, miss double")


def _dense(members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) among all nodes (label, size, node, vector) of one label and size, as forests of blocks."""
    dealt = in_block_pairs(members, ["label", "size"], "node", DENSE_BLOCK)

    def run(batches):
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        table = pa.Table.from_batches(own)
        keys = np.stack([table.column("label").combine_chunks().dictionary_encode().indices.to_numpy(), *(table.column(c).to_numpy() for c in ("size", "i", "j"))])
        cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), table.num_rows]
        for low, high in zip(cut[:-1], cut[1:], strict=True):
            part = table.slice(low, high - low).combine_chunks()
            unit, node, first = _matrix(part.column("vector").chunk(0)), part.column("node").to_numpy(), part.column("own").to_numpy() == keys[2, low]
            x, y = (np.arange(len(node)),) * 2 if keys[2, low] == keys[3, low] else (np.flatnonzero(first), np.flatnonzero(~first))
            other = unit[y].T
            for k in range(0, len(x), ROWS):
                p, q = np.nonzero(unit[x[k : k + ROWS]] @ other >= threshold)
                p, q = node[x[k + p]], node[y[q]]
                apart = p != q
                if apart.any():
                    a, b = forest(p[apart], q[apart])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    order = ["label", "size", "i", "j"]
    return dealt.repartition(tasks_for(dealt, 64 << 20), *order).sortWithinPartitions(*order).select(*order, "own", "node", "vector").mapInArrow(run, "a long, b long")


def _count(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links): the summed weights of the nodes that each is linked with, for nodes (component, node, weight, vector)."""
    dealt = in_block_pairs(members, ["component"], "node", COUNT_BLOCK).select("component", "i", "j", "own", "node", "weight", "vector")

    def run(batches):
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        table = pa.Table.from_batches(own)
        keys = np.stack([table.column(c).to_numpy() for c in ("component", "i", "j")])
        cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), table.num_rows]
        for low, high in zip(cut[:-1], cut[1:], strict=True):
            part = table.slice(low, high - low).combine_chunks()
            unit, weight, node = _matrix(part.column("vector").chunk(0)), part.column("weight").to_numpy(), part.column("node").to_numpy()
            first = part.column("own").to_numpy() == keys[1, low]
            if keys[1, low] == keys[2, low]:
                found = np.zeros(len(node), np.int64)
                for k in range(0, len(node), 1024):
                    near = unit[k : k + 1024] @ unit.T >= threshold
                    near[np.arange(len(near)), k + np.arange(len(near))] = False
                    found[k : k + 1024] = near @ weight
            else:
                found, x, y = np.zeros(len(node), np.int64), np.flatnonzero(first), np.flatnonzero(~first)
                for k in range(0, len(x), 1024):
                    near = unit[x[k : k + 1024]] @ unit[y].T >= threshold
                    found[x[k : k + 1024]] += near @ weight[y]
                    found[y] += weight[x[k : k + 1024]] @ near
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(found)], ["node", "links"])

    parts = tasks_for(dealt, 64 << 20)
    counted = dealt.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(run, "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def dedup(df: DataFrame, threshold: float = THRESHOLD, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    scratch = Scratch(df.sparkSession, "vectors")
    rows = pick(df, vec_id=id_col, vector=vector_col, label=label_col)
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.filter("usable")
    classes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = scratch.write(classes.select("label", "vector", F.size("vector").alias("size"), "least", "weight", F.monotonically_increasing_id().alias("node")), "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    windows = scratch.write(_windows(_keyed(classes, passes_for(most, threshold), seed), threshold), "windows")
    dense = windows.filter("miss is not null").groupBy(F.col("a").alias("node")).agg(F.sum("miss").alias("miss")).filter(F.col("miss") > math.log(MISS)).select("node")
    dense = scratch.write(classes.join(dense, "node").select("label", "size", "node", "vector"), "dense")
    edges = scratch.write(windows.filter("miss is null").select("a", "b").union(_dense(dense, threshold)).distinct(), "edges")
    scratch.drop(windows, dense)
    found = scratch.write(components(edges, scratch), "components")
    members = scratch.write(found.join(classes.select("node", "weight", "vector"), "node"), "members")
    links = _count(members, threshold)
    least = found.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("first"))
    of_node = scratch.write(found.join(least, "component").join(links, "node", "left").select("node", "first", "links"), "links")
    of_class = classes.join(of_node, "node", "left").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("first", "least").alias("component_id"))
    linked = good.join(of_class, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

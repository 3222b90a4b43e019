"""Small dense algorithms that end on the driver or in one task for each key; their sizes are bounded and checked."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.operators.solvers import MOST_DENSE

#: Complementary letters: Watson-Crick pairs and the wobble pair, with T as U.
PAIRS = {("A", "T"), ("T", "A"), ("C", "G"), ("G", "C"), ("G", "T"), ("T", "G")}


def most_pairs(s: str, loop: int = 3) -> int:
    """The most nested base pairs of a strand with at least ``loop`` bases inside each pair."""
    n = len(s)
    best = np.zeros((n + 1, n + 1), np.int32)
    for span in range(loop + 1, n):
        for i in range(n - span):
            j = i + span
            top = max(best[i + 1, j], best[i, j - 1])
            if (s[i], s[j]) in PAIRS:
                top = max(top, best[i + 1, j - 1] + 1)
            if span > 1:
                top = max(top, int((best[i, i:j] + best[i + 1 : j + 1, j]).max()))
            best[i, j] = top
    return int(best[0, n - 1]) if n else 0


def folding(seqs: DataFrame, key: str, seq: str, window: int) -> DataFrame:
    """(key, start, pairs) for the windows of each sequence; the recursion is cubic in the window only."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0)), F.lit(window))
    parts = seqs.select(key, F.explode(starts).alias("start"), seq).select(key, "start", F.substring(seq, F.col("start") + 1, F.lit(window)).alias("part"))

    def each(part: pd.Series) -> pd.Series:
        return part.map(most_pairs)

    return parts.select(key, "start", F.pandas_udf(each, "int")("part").alias("pairs"))


def biclusters(table: DataFrame, row: str, column: str, weight: str, k: int) -> DataFrame:
    """(kind, name, cluster) from the singular vectors of the degree-normalised matrix of two small dimensions."""
    spark = table.sparkSession
    cells = table.groupBy(row, column).agg(F.sum(weight).alias("w")).limit(MOST_DENSE * 64 + 1).collect()
    rows, columns = sorted({r[0] for r in cells}), sorted({r[1] for r in cells})
    if len(rows) > MOST_DENSE or len(columns) > MOST_DENSE or len(cells) > MOST_DENSE * 64:
        raise ValueError("the matrix is too large for a dense solve")
    a = np.zeros((len(rows), len(columns)))
    for r in cells:
        a[rows.index(r[0]), columns.index(r[1])] = r[2]
    dr, dc = np.sqrt(np.maximum(a.sum(1), 1e-12)), np.sqrt(np.maximum(a.sum(0), 1e-12))
    u, _, vt = np.linalg.svd(a / dr[:, None] / dc[None, :], full_matrices=False)
    z = np.concatenate([u[:, 1:k] / dr[:, None], vt[1:k].T / dc[:, None]])
    z *= np.sign(z[np.abs(z).argmax(0), np.arange(z.shape[1])])
    # centres: the farthest points from those chosen, from the first on; then Lloyd's steps
    centre = [0]
    while len(centre) < min(k, len(z)):
        centre.append(int(np.min([((z - z[c]) ** 2).sum(1) for c in centre], axis=0).argmax()))
    m = z[centre]
    for _ in range(50):
        label = ((z[:, None] - m[None]) ** 2).sum(2).argmin(1)
        m = np.array([z[label == i].mean(0) if (label == i).any() else m[i] for i in range(len(m))])
    named = [("row", str(x)) for x in rows] + [("column", str(x)) for x in columns]
    return spark.createDataFrame([(*n, int(c)) for n, c in zip(named, label, strict=True)], "kind string, name string, cluster int")


#: Nodes that the axes of an Isomap are fitted on, and how many lengths of paths one task holds at once.
LANDMARKS, LENGTHS = 1024, 1 << 22


def path_lengths(starts: np.ndarray, dst: np.ndarray, w: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Shortest paths from each source to all nodes over directed edges, infinite without a path; a node's edges are those from its ``starts`` on.

    All sources go on together by rounds, each over the edges of nodes that came nearer in the one before. Nodes beyond a
    limit wait until all within it are settled, so few are met again, and a round costs no more than its edges.
    """
    n = len(starts) - 1
    d, last = np.full(len(sources) * n, np.inf), np.empty(len(sources) * n, np.int32)
    now = np.arange(len(sources)) * n + sources
    d[now] = 0.0
    finite = w[np.isfinite(w)]
    step = 2 * float(np.abs(finite).mean()) if len(finite) else 0.0
    limit, later = step, []

    def once(at: np.ndarray) -> np.ndarray:
        order = np.arange(len(at), dtype=np.int32)
        last[at] = order
        return at[last[at] == order]

    while len(now):
        node = now % n
        many = starts[node + 1] - starts[node]
        edge = np.repeat(starts[node] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        to, new = np.repeat(now - node, many) + dst[edge], np.repeat(d[now], many) + w[edge]
        nearer = new < d[to]
        to = to[nearer]
        np.minimum.at(d, to, new[nearer])
        to = once(to)
        within = d[to] <= limit
        now = to[within]
        later.append(to[~within])
        if not len(now):
            waiting = np.concatenate(later)
            now, later = once(waiting[d[waiting] > limit]), []
            if len(now):
                limit = float(d[now].min()) + step
                within = d[now] <= limit
                now, later = now[within], [now[~within]]
    return d.reshape(len(sources), n)


def isomap(edges: DataFrame, nodes: DataFrame, dimensions: int) -> DataFrame:
    """(id, axis, x): scaling of shortest path lengths over a neighbour graph (src, dst, w), both ways, by landmarks.

    The ``LANDMARKS`` nodes whose ids hash least, or all nodes where there are no more, are scaled classically; every node
    is placed by its lengths to them, which for landmarks gives the same place. Nodes without a path are 1.5 times the
    longest one away. The graph and the lengths of the landmarks among each other are on the driver.
    """
    spark, context = edges.sparkSession, edges.sparkSession.sparkContext
    ids = np.sort(nodes.select(F.col("id").cast("long")).distinct().dropna().toPandas()["id"].to_numpy(np.int64))
    marks = nodes.select("id").distinct().dropna().orderBy(F.xxhash64(F.col("id").cast("long")), "id").limit(LANDMARKS).toPandas()["id"].to_numpy(np.int64)
    marks = np.searchsorted(ids, np.sort(marks))
    if not len(marks):
        return spark.createDataFrame([], "id long, axis int, x double")
    e = edges.groupBy(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).agg(F.min("w").cast("double").alias("w")).toPandas()
    e = e[e["src"].isin(ids) & e["dst"].isin(ids)].sort_values(["src", "dst"])
    src, dst = (np.searchsorted(ids, e[c].to_numpy(np.int64)) for c in ("src", "dst"))
    graph = context.broadcast((np.searchsorted(src, np.arange(len(ids) + 1)), dst, e["w"].to_numpy(float)))
    share = max(1, min(LENGTHS // len(ids), -(-len(marks) // (2 * context.defaultParallelism))))
    groups = [(i, marks[i : i + share]) for i in range(0, len(marks), share)]
    dealt = context.parallelize(groups, len(groups))

    def among(group: tuple[int, np.ndarray]) -> tuple[np.ndarray, float]:
        d = path_lengths(*graph.value, group[1])
        return d[:, marks], float(d[np.isfinite(d)].max())

    parts = dealt.map(among).collect()
    far = 1.5 * max(top for _, top in parts)
    d = np.concatenate([part for part, _ in parts])
    d[np.isinf(d)] = far
    square = (d**2).mean(0)
    values, vectors = np.linalg.eigh(-0.5 * (d**2 - square - square[:, None] + square.mean()))
    top = np.argsort(-values)[:dimensions]
    values, vectors = values[top], vectors[:, top]
    known = vectors * np.sqrt(np.maximum(values, 0))
    sign = np.sign(known[np.abs(known).argmax(0), np.arange(known.shape[1])])
    # x = V' (mean of squares - squares) / 2 / sqrt(value), which needs the sum over landmarks only
    axes = np.where(values > 1e-12 * max(1.0, float(values.max())), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0) * sign * vectors

    def placed(group: tuple[int, np.ndarray]) -> np.ndarray:
        at, sources = group
        own = path_lengths(*graph.value, sources)
        own[np.isinf(own)] = far
        return -0.5 * (own**2 - square[at : at + len(sources), None]).T @ axes[at : at + len(sources)]

    x = dealt.map(placed).treeReduce(np.add)
    out = pd.DataFrame({"id": np.repeat(ids, x.shape[1]), "axis": np.tile(np.arange(x.shape[1], dtype=np.int32), len(ids)), "x": x.ravel()})
    return spark.createDataFrame(out, "id long, axis int, x double")


def selective_scan(df: DataFrame, key: str, order: str, delta: str, x: str, a: float, d: float) -> DataFrame:
    """(key, order, y): h = exp(-softplus(delta) a) h + softplus(delta) x and y = h + d x along each key's order."""

    def one(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        step = np.log1p(np.exp(pdf[delta].to_numpy(float)))
        xs, h, out = pdf[x].to_numpy(float), 0.0, []
        for s, v in zip(step, xs, strict=True):
            h = np.exp(-s * a) * h + s * v
            out.append(h + d * v)
        return pd.DataFrame({key: name[0], order: pdf[order].to_numpy(), "y": out})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(key, order, delta, x).groupBy(key).applyInPandas(one, f"{key} {kinds[key]}, {order} {kinds[order]}, y double")

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.operators import dense, graph, sketches, solvers
from meshlark.sources import packed


def test_varints():
    values = np.array([0, 1, 127, 128, 300, 2**35, 2**63], np.uint64)
    assert packed.unvarints(packed.varints(values)).tolist() == values.tolist()
    assert packed.unvarints(b"").tolist() == []


def test_point_cloud_is_small_and_true():
    rng = np.random.default_rng(1)
    xyz = rng.normal(0, 25, (3, 2000))
    raw, order = packed.encode_cloud(xyz)
    back = packed.decode_cloud(raw)
    span = xyz.max(1) - xyz.min(1)
    assert (np.abs(back - xyz[:, order]) <= span[:, None] / 65535).all() and len(raw) < xyz.nbytes / 3
    with pytest.raises(ValueError):
        packed.decode_cloud(raw[:-1])
    one, _ = packed.encode_cloud(np.array([[1.0], [2.0], [3.0]]))
    assert np.allclose(packed.decode_cloud(one)[:, 0], [1, 2, 3])


def pairs_by_force(s, loop=3):
    best = 0
    for n in range(len(s) // 2 + 1):
        options = [(i, j) for i in range(len(s)) for j in range(i + loop + 1, len(s)) if (s[i], s[j]) in dense.PAIRS]
        for chosen in itertools.combinations(options, n):
            ends = [x for p in chosen for x in p]
            nested = all(not (a[0] < b[0] < a[1] < b[1]) for a in chosen for b in chosen)
            if len(set(ends)) == len(ends) and nested:
                best = max(best, n)
    return best


def test_folding_against_force():
    rnd = random.Random(1)
    for _ in range(25):
        s = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 10)))
        assert dense.most_pairs(s) == pairs_by_force(s)


def test_count_min_never_falls_short(spark):
    items = spark.createDataFrame([(i % 50,) for i in range(1000)] + [(i,) for i in range(50, 600)], "k long")
    got = {r.k: r.estimate for r in sketches.estimate(sketches.count_min(items, "k", 64), spark.range(700).select(F.col("id").alias("k")), "k", 64).collect()}
    exact = {r.k: r["count"] for r in items.groupBy("k").count().collect()}
    assert all(got[k] >= exact.get(k, 0) for k in got) and len(got) == 700


def test_bloom_has_no_false_negatives(spark):
    items = spark.range(0, 900, 3).select(F.col("id").alias("k"))
    got = {r.k: r.maybe for r in sketches.contained(sketches.bloom(items, "k", 4096), spark.range(900).select(F.col("id").alias("k")), "k", 4096).collect()}
    assert all(got[k] for k in range(0, 900, 3)) and sum(got.values()) < 500


def test_gaussian_process_solves_its_system(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.uniform(0, 4), rnd.uniform(0, 4), rnd.uniform(-1, 1)) for i in range(40)]
    got = {r.id: r.mean for r in solvers.gaussian_process(spark.createDataFrame(rows, "id long, x double, y double, u double"), 1.5, 0.2).collect()}
    xy, u = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    q = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)) / 1.5
    k = np.where(q < 1, (1 - q) ** 4 * (4 * q + 1), 0)
    assert np.allclose([got[i] for i in range(40)], k @ np.linalg.solve(k + 0.2 * np.eye(40), u))


def test_isomap_of_a_line(spark):
    edges = [(i, i + 1, 1.0) for i in range(9)]
    df = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "src long, dst long, w double")
    got = sorted((r.id, r.x) for r in dense.isomap(df, spark.range(10), 1).collect())
    steps = np.diff([x for _, x in got])
    assert np.allclose(np.abs(steps), 1.0) and (np.sign(steps) == np.sign(steps[0])).all()


def test_gaussian_process_of_many_points_with_copies(spark, monkeypatch):
    monkeypatch.setattr(solvers, "MOST_DENSE", 30)
    monkeypatch.setattr(solvers, "KERNEL_ROWS", 7)
    rnd = random.Random(6)
    rows = [(i, rnd.randrange(8) / 2, rnd.randrange(8) / 2, rnd.uniform(-1, 1)) for i in range(150)]
    got = {r.id: r.mean for r in solvers.gaussian_process(spark.createDataFrame(rows, "id long, x double, y double, u double"), 1.5, 0.2).collect()}
    xy, u = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    q = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)) / 1.5
    k = np.where(q < 1, (1 - q) ** 4 * (4 * q + 1), 0)
    assert np.allclose([got[i] for i in range(150)], k @ np.linalg.solve(k + 0.2 * np.eye(150), u))


def test_gaussian_process_of_many_places_needs_few_steps(spark, monkeypatch):
    monkeypatch.setattr(solvers, "MOST_DENSE", 30)
    monkeypatch.setattr(solvers, "MOST_STEPS", 20)
    rnd = random.Random(7)
    rows = [(i, rnd.uniform(-4, 4), rnd.uniform(0, 3), rnd.uniform(-1, 1)) for i in range(400)]
    odd = [(400, 0.5, 0.5, None), (401, None, 1.0, 1.0), (402, float("nan"), 1.0, 1.0), (403, 90.0, -90.0, 2.2), (404, float("inf"), 0.0, 1.0)]
    got = {r.id: r.mean for r in solvers.gaussian_process(spark.createDataFrame(rows + odd, "id long, x double, y double, u double"), 2.0, 0.1).collect()}
    xy, u = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    q = np.sqrt(((np.vstack([xy, [0.5, 0.5]])[:, None] - xy[None]) ** 2).sum(2)) / 2.0
    k = np.where(q < 1, (1 - q) ** 4 * (4 * q + 1), 0)
    want = k @ np.linalg.solve(k[:400] + 0.1 * np.eye(400), u)
    assert np.allclose([got[i] for i in range(401)], want, rtol=0, atol=1e-7)
    assert got[401] == got[402] == got[404] == 0 and abs(got[403] - 2.0) < 1e-7


def test_isomap_places_all_nodes_by_landmarks(spark, monkeypatch):
    monkeypatch.setattr(dense, "MOST_DENSE", 30)
    monkeypatch.setattr(dense, "LANDMARKS", 20, raising=False)
    edges = [(i, i + 1, 1.0) for i in range(59)]
    df = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "src long, dst long, w double")
    steps = np.diff([x for _, x in sorted((r.id, r.x) for r in dense.isomap(df, spark.range(60), 1).collect())])
    assert len(steps) == 59 and np.allclose(np.abs(steps), 1.0) and (np.sign(steps) == np.sign(steps[0])).all()


def test_path_lengths_meet_edges_a_few_times_only():
    class Counted(np.ndarray):
        met = 0

        def __getitem__(self, at):
            Counted.met += np.size(at)
            return np.asarray(super().__getitem__(at))

    rng = np.random.default_rng(8)
    n = 600  # a chain, where a path has hundreds of edges, with shortcuts and repeated, directed and weightless edges
    src, dst = np.append(np.arange(n - 1), rng.integers(0, n - 50, 300)), np.append(np.arange(1, n), rng.integers(0, n - 50, 300))
    w = np.append(rng.random(n - 1), np.where(rng.random(300) < 0.3, 0, 40 * rng.random(300)))
    order = np.lexsort((dst, src))
    src, dst, w, sources = src[order], dst[order], w[order], np.array([0, 5, 300, 599, 0])
    want = np.full((5, n), np.inf)
    want[np.arange(5), sources] = 0
    for _ in range(n):
        for row in want:
            np.minimum.at(row, dst, row[src] + w)
    got = dense.path_lengths(np.searchsorted(src, np.arange(n + 1)), dst, w.view(Counted), sources)
    assert (got == want).all() and np.isinf(got).any()
    assert Counted.met < 4 * len(sources) * len(w)


def test_isomap_of_a_long_chain_ends_soon(spark, monkeypatch):
    monkeypatch.setattr(dense, "LANDMARKS", 16)
    n, began = 12000, time.monotonic()
    df = spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst", "1.0D AS w")
    got = np.array(sorted((r.id, r.x) for r in dense.isomap(df.union(df.select("dst", "src", "w")), spark.range(n), 1).collect()))
    assert np.allclose(np.abs(np.diff(got[:, 1])), 1.0) and len(got) == n
    assert time.monotonic() - began < 30  # some 3 seconds; rounds over all edges had not ended after a minute


def test_pagerank_sums_to_one_and_stays_near_the_seed(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (5, 6, 1.0)], "src long, dst long, w double")
    seed = spark.createDataFrame([(0, 2.0)], "id long, s double")
    got = {r.id: r["rank"] for r in graph.personalised_pagerank(edges, seed, 0.2, 12).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and 5 not in got and got[1] > got[3]


def test_selective_scan(spark):
    df = spark.createDataFrame([(1, i, 0.3 * i, float(i)) for i in range(5)], "k long, t long, d double, x double")
    got = [r.y for r in dense.selective_scan(df, "k", "t", "d", "x", 0.5, 0.1).orderBy("t").collect()]
    h, want = 0.0, []
    for i in range(5):
        s = np.log1p(np.exp(0.3 * i))
        h = np.exp(-s * 0.5) * h + s * i
        want.append(h + 0.1 * i)
    assert np.allclose(got, want)

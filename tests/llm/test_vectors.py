from __future__ import annotations

import numpy as np

from meshlark.llm import vector_dedup


def brute(rows, threshold=0.98):
    n = len(rows)
    unit = []
    for _, v, label in rows:
        ok = label is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)
        unit.append((np.array(v, float) / np.linalg.norm(v), label) if ok else None)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and unit[i][1] == unit[j][1] and len(unit[i][0]) == len(unit[j][0]) and unit[i][0] @ unit[j][0] >= threshold] for i in range(n)]
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        part, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in part:
                    part.add(j), todo.append(j)
        seen |= part
        least = min((rows[j][0] for j in part if rows[j][0] is not None), default=None)
        for j in part:
            out[j] = (rows[j][0], len(near[j]), least, rows[j][0] == least and least is not None)
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16)).astype(np.float32)
    rows = []
    for i in range(500):
        v = base[rng.integers(40)] + np.float32(rng.choice([0, 0.02, 0.06, 0.3])) * rng.standard_normal(16).astype(np.float32)
        rows.append((i, v.tolist(), int(rng.integers(3))))
    rows += [(1000 + i, (base[0] + np.float32(0.04) * rng.standard_normal(16)).astype(np.float32).tolist(), 0) for i in range(150)]
    rows += [(2000 + i, base[1].tolist(), 1) for i in range(40)] + [(3000, (2 * base[1]).tolist(), 1), (3001, [0.0] * 16, 1), (3002, None, 1), (3003, base[1].tolist(), None)]
    rows += [(3004, [float("nan")] + [1.0] * 15, 1), (3005, [float("inf")] + [1.0] * 15, 1), (3006, [None] + [1.0] * 15, 1), (3007, [], 1), (None, base[1].tolist(), 1), (5, base[1].tolist(), 1), (5, base[1].tolist(), 1), (3008, [1.0] * 3, 1), (3009, [1.0] * 3, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, LABEL int").repartition(6)
    got = sorted((tuple(r) for r in vector_dedup.dedup(df).collect()), key=repr)
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    assert got == want


def test_empty(spark):
    assert vector_dedup.dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_passes_grow_slowly():
    assert vector_dedup.passes_for(100) < vector_dedup.passes_for(10**6) < vector_dedup.passes_for(10**9) < 100


def test_clustered_label_loses_no_link(spark):
    rng = np.random.default_rng(11)
    centre = rng.standard_normal(64)
    centre *= np.sqrt(19 * 64) / np.linalg.norm(centre)  # mutual cosines about 0.95
    rows = (centre + rng.standard_normal((12000, 64))).astype(np.float32)
    planted = rows[:400] + np.float32(0.83) * rng.standard_normal((400, 64)).astype(np.float32)
    rows = np.concatenate([rows, planted])
    unit = rows.astype(np.float64) / np.linalg.norm(rows.astype(np.float64), axis=1)[:, None]
    want = {}
    for i in range(0, len(unit), 1000):
        near = unit[i : i + 1000] @ unit.T >= 0.98
        want |= dict(zip(range(i, i + 1000), (near.sum(1) - 1).tolist()))
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows.tolist())], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in vector_dedup.dedup(df).select("vec_id", "n_links").collect()}
    assert sum(n > 0 for n in want.values()) > 200
    assert got == {i: want[i] for i in range(len(rows))}


def test_prefixes_against_counts():
    rng = np.random.default_rng(2)
    keys = np.sort(np.concatenate([rng.integers(0, 1 << 63, 3000), rng.integers(0, 1 << 40, 500), np.full(140, 1 << 50)]))
    need = vector_dedup.prefix_bits(keys, False, False)
    for i in range(0, len(keys), 97):
        shared = [(keys >> (63 - b) == keys[i] >> (63 - b)).sum() if b else len(keys) for b in range(64)]
        assert need[i] == next((b for b in range(64) if shared[b] <= vector_dedup.WINDOW), 64)

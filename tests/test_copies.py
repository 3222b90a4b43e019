"""Tables whose rows are repeated under other keys: results of the SQL, without pairs of copies in the joins."""

from __future__ import annotations

import importlib

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from meshlark.operators import spatial

COPIES = 4
KEYS = {"customer": "c_custkey", "supplier": "s_suppkey"}


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Customers and suppliers of sf0.001, each four times; keys of copies are multiples of 210 apart, as some columns are made of remainders."""
    folder = tmp_path_factory.mktemp("copies")
    for name, key in KEYS.items():
        source = f"/root/testdata/sf0.001/{name}.parquet"
        step = duckdb.sql(f"SELECT max({key}) + 2 FROM '{source}'").fetchall()[0][0]
        duckdb.sql(f"COPY (SELECT t.* REPLACE (({key} + g * {step + -step % 210})::BIGINT AS {key}) FROM '{source}' t, (SELECT unnest(range({COPIES})) AS g)) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def wanted(folder, name, columns):
    c = duckdb.connect()
    for t in KEYS:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return sorted(c.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall())


#: Pairs that come out of range joins, at most; each copy on its own would make four to sixteen times as many.
MOST_PAIRS = {
    "wavelet_coefficients": 600,
    "born_radii": 600,
    "component_summary": 200,
    "connected_components_eps": 200,
    "contact_hubs": 300,
    "contact_map_tiers": 300,
    "exposed_area": 400,
    "kernel_choices": 300,
    "knn_grid": 6000,
    "meshfree_laplacian": 300,
    "message_passing": 300,
    "pair_distance_histogram": 500,
}


@pytest.mark.parametrize("name", sorted(MOST_PAIRS))
def test_copies_meet_as_classes(spark, copies, name, monkeypatch):
    join, made = spatial.range_join, []

    def counted(*args, **kwargs):
        out = join(*args, **kwargs)
        made.append(out.count())
        return out

    for module in ("operators.spatial", "operators.solvers", "operators.fields", "plans.graph_queries"):
        monkeypatch.setattr(importlib.import_module(f"meshlark.{module}"), "range_join", counted, raising=False)
    got = queries()[name](spark, copies)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == wanted(copies, name, columns)
    assert 0 < sum(made) <= MOST_PAIRS[name]


@pytest.mark.parametrize("name", ["direct_potential", "fmm_potential_error"])
def test_copies_meet_as_classes_in_potentials(spark, copies, name, monkeypatch):
    from meshlark.operators import fields

    tiles, rows = fields.tiled_pairs, []

    def counted(left, right, *args):
        rows.append(left.count())
        return tiles(left, right, *args)

    monkeypatch.setattr(fields, "tiled_pairs", counted)
    got = queries()[name](spark, copies)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == wanted(copies, name, columns)
    assert rows and max(rows) < spark.read.parquet(f"{copies}/supplier.parquet").count()


def test_loops_of_copies_against_all_edges(spark, copies, monkeypatch):
    from meshlark.operators import graph

    rows = duckdb.sql(f"SELECT c_custkey, c_acctbal / 10.0, c_nationkey * 2.0::DOUBLE FROM '{copies}/customer.parquet' ORDER BY 1").fetchall()
    edges = sorted((((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5, a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 9)
    root, tree = {r[0]: r[0] for r in rows}, []

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for w, a, b in edges:
        if top(a) != top(b):
            root[max(top(a), top(b))] = min(top(a), top(b))
            tree.append((a, b))
    rest = [(a, b) for _, a, b in edges if (a, b) not in set(tree)]
    given, forest = [], graph.spanning_forest
    monkeypatch.setattr(graph, "spanning_forest", lambda nodes, held: (given.append(held.count()), forest(nodes, held))[1])
    got = queries()["room_graph"](spark, copies).collect()
    assert sorted((r.src, r.dst) for r in got if r.tree) == sorted(tree)
    assert sorted((r.src, r.dst) for r in got if not r.tree) == sorted(rest[: len(rest) // 10])
    assert given[0] < len(edges) // 8

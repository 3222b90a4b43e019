from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshlark.functions import cells, text
from meshlark.operators import fields, graph, ordered, sequence, series, similarity, solvers, spatial, stats
from meshlark.plans import catalogue
from meshlark.sources import pdb


def points(n, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.uniform(-3, 3), rnd.uniform(-3, 3), rnd.uniform(-1, 1)) for i in range(n)]
    return rows + [(n, rows[0][1], rows[0][2], 0.5), (n + 1, -1.0, 0.0, 1.0), (n + 2, 0.0, 0.0, 1.0)]


def test_range_join_on_cell_borders_and_negative_cells(spark):
    rows = points(60)
    df = spark.createDataFrame(rows, "id long, x double, y double, q double").repartition(3)
    for strict in (False, True):
        got = {(r.l_id, r.r_id) for r in spatial.range_join(df, df, ["x", "y"], 1.0, strict=strict, keep=F.col("l_id") < F.col("r_id")).collect()}
        d2 = lambda a, b: (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2
        assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (d2(a, b) < 1 if strict else d2(a, b) <= 1)}
        assert ((61, 62) in got) != strict


def test_operators_on_empty_tables(spark):
    df = spark.createDataFrame([], "id long, x double, y double, q double")
    assert spatial.range_join(df, df, ["x", "y"], 1.0).count() == 0
    assert spatial.knn_join(df, df, ["x", "y"], 3, 1.0).count() == 0
    assert fields.near_far_potential(df, 1.0, 3).count() == 0
    assert graph.components(df.select("id"), spark.createDataFrame([], "src long, dst long, w double")).count() == 0


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="z"):
        spatial.box_aggregate(spark.range(1), {"z": (0, 1)}, F.lit(1))


def test_morton_round_trip(spark):
    df = spark.createDataFrame([(3, 5, 7), (0, 0, 0), (15, 1, 8)], "a long, b long, c long")
    code = cells.morton([F.col(c) for c in "abc"], 4)
    got = df.select("*", *[cells.unmorton(code, i, 3, 4).alias(f"{c}2") for i, c in enumerate("abc")]).collect()
    assert all((r.a, r.b, r.c) == (r.a2, r.b2, r.c2) for r in got)


def test_kmers_cross_pieces(spark):
    s = "".join(random.Random(1).choice("ACGTé") for _ in range(1500))
    df = spark.createDataFrame([(s,), ("AC",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(text.kmers(F.col("s"), 3)).collect()]
    assert got == [[s[i : i + 3] for i in range(1498)], [], [], []]
    assert [r[0] for r in df.select(text.grams(F.col("s"), 3)).limit(2).collect()][1] == ["AC"]


def test_ordered_sum_and_lag_over_ranges(spark):
    rows = [(i, (i * 37) % 101, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k long, v long").repartition(7)
    want, run, before = {}, 0, -1
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        run += v
        want[i] = (run, before)
        before = v
    got = ordered.ordered_lag(ordered.ordered_sum(df, ["k", "id"], "v", "run"), ["k", "id"], "v", "last", -1).collect()
    assert {r.id: (r.run, r.last) for r in got} == want


def test_spanning_forest_against_kruskal(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(40), rnd.randrange(40), float(rnd.randint(1, 9))) for _ in range(90)]
    got = graph.spanning_forest(spark.range(40), spark.createDataFrame(edges, "src long, dst long, w double")).collect()
    root = list(range(40))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    total = n = 0
    for a, b, w in sorted(edges, key=lambda e: e[2]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total, n = total + w, n + 1
    assert (len(got), sum(r.w for r in got)) == (n, total)


def test_near_far_potential_converges(spark):
    df = spark.createDataFrame(points(150)[:150], "id long, x double, y double, q double")
    exact = {r.id: r.phi for r in fields.direct_potential(df, 0.0).collect()}
    worst = []
    for order in (1, 4, 8):
        got = {r.id: r.phi for r in fields.near_far_potential(df, 0.75, order).collect()}
        worst.append(max(abs(got[i] - exact[i]) for i in exact))
    assert worst[0] > worst[1] > worst[2] and worst[2] < 1e-3


def test_chain_prefers_colinear_anchors(spark):
    hits = [("q", "r", i, 100 + i) for i in range(0, 200, 10)] + [("q", "r", 5, 900), ("q", "r", 150, 3)]
    df = spark.createDataFrame(hits, "query string, ref string, query_pos long, ref_pos long")
    (r,) = sequence.chain(df, 15).collect()
    assert (r.anchors, r.ref_start, r.ref_end) == (20, 100, 305)
    assert sequence.best_chain(pd.DataFrame({"ref_pos": [4], "query_pos": [2]}), 15) == (15.0, [0])


def test_gop_step_and_stream_agree(spark):
    assert [k for _, k, _, _ in series.gop_step([(0, 0), (1, 0), (2, 0), (3, 0)], 2, 3, 18, 3)] == ["IDR", "B", "B", "IDR"]
    assert [k for _, k, _, _ in series.gop_step([(0, 0), (1, (1 << 40) - 1), (2, 0), (3, (1 << 40) - 1)], 2, 30, 18, 3)] == ["IDR", "B", "IDR", "B"]
    sf = "/root/testdata/sf0.001"
    q = catalogue.queries()
    assert sorted(map(tuple, q["gop_decisions"](spark, sf).collect())) == sorted(map(tuple, q["stream_gop_decisions"](spark, sf).collect()))


def test_dtw():
    assert series.dtw([1, 2, 3], [1, 2, 2, 3]) == 0.0
    assert series.dtw([0, 0], [1, 1]) == 2.0


def test_weighted_median_and_folds(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 9.0, 5.0), ("b", 3.0, 1.0)], "g string, v double, w double")
    assert {r.g: r["median"] for r in stats.weighted_median(df, "g", "v", "w").collect()} == {"a": 9.0, "b": 3.0}
    folds = spark.range(5000).select(stats.group_fold(F.col("id"), 5).alias("f")).groupBy("f").count().collect()
    assert len(folds) == 5 and min(r["count"] for r in folds) > 700


def test_pdb_lines(spark):
    lines = [
        "ATOM      1  N   MET A   1      27.340  24.430   2.614  1.00  9.67           N",
        "HETATM    2 ZN    ZN B 201      -1.000   2.000   3.500  1.00  9.67          ZN",
        "ATOM      3  CA  MET A   1      xx.340  24.430   2.614  1.00  9.67           C",
        "REMARK ATOM",
        "ATOM",
    ]
    got = pdb.parse(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("atom_id").collect()
    assert [(r.atom_id, r.atom_name, r.chain, r.res_id, r.x, r.element, r.radius) for r in got] == [(1, "N", "A", 1, 27.34, "N", 1.55), (2, "ZN", "B", 201, -1.0, "ZN", 1.7)]


def test_frequent_seeds_keep_their_hits(spark, monkeypatch):
    monkeypatch.setattr(sequence, "SEED_ROWS", 100)
    refs = spark.createDataFrame([(i, 3, "ACGT") for i in range(700)] + [(1, 9, "TTTT"), (2, 9, "GGGG")], "ref long, pos int, kmer string")
    queries = spark.createDataFrame([(1, 5, "ACGT"), (2, 6, "ACGT"), (2, 7, "TTTT"), (3, 1, "CCCC")], "query long, pos int, kmer string")
    want = sorted([(q, p, i, 3) for q, p in ((1, 5), (2, 6)) for i in range(700)] + [(2, 7, 1, 9)])
    assert sorted((r.query, r.query_pos, r.ref, r.ref_pos) for r in sequence.seed_hits(refs, queries).collect()) == want
    assert [tuple(r) for r in sequence.seed_hits(refs, queries, 50).select("query", "query_pos", "ref", "ref_pos").collect()] == [(2, 7, 1, 9)]


def test_chains_of_much_copied_passages(spark, tmp_path):
    from meshlark.plans import similarity_queries

    rnd = random.Random(7)
    passage = "".join(rnd.choice("abcdefgh") for _ in range(120))
    spark.createDataFrame([(i, passage) for i in range(60)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r.ref for r in similarity_queries.chain_anchors(spark, str(tmp_path)).collect()} == set(range(60))
    assert similarity_queries.minimizer_hits_all(spark, str(tmp_path)).count() == 60


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("distance", [0, 2, 3])
def test_fuzzy_join_beyond_one_edit_against_all_pairs(spark, distance):
    rnd = random.Random(5)
    words = {"", "a", "ab", "international", "internationals", "xnternatonal", "é", "überall"}
    while len(words) < 150:
        w = list(rnd.choice(sorted(words)))
        for _ in range(rnd.randint(1, 3)):
            at = rnd.randint(0, len(w))
            w[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "ca"])
        words.add("".join(w)[:20])
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    got = {(r.l_word, r.r_word): r.distance for r in similarity.fuzzy_join(df, df, distance).collect()}
    assert got == {(a, b): d for a in words for b in words if (d := edits(a, b)) <= distance}


def test_fuzzy_words_are_whole(spark, tmp_path):
    from meshlark.plans import similarity_queries

    spark.createDataFrame([(1, "International trade, überall so"), (2, "internatoinal uberall to")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.l_word, r.r_word) for r in similarity_queries.fuzzy_words(spark, str(tmp_path)).collect() if r.l_word < r.r_word}
    assert got == {("international", "internatoinal"), ("uberall", "überall"), ("so", "to")}


def test_power_centrality_takes_every_edge(spark, monkeypatch):
    monkeypatch.setattr(solvers, "MOST_DENSE", 140)  # the complete graph has more than 64 edges for each node
    n = 140
    edges = [(i, j, 1.0) for i in range(n) for j in range(i)]
    got = solvers.power_centrality(spark.createDataFrame(edges, "src long, dst long, w double")).collect()
    assert len(got) == n and all(r.centrality == pytest.approx(n / (2 * (n - 1))) for r in got)
    with pytest.raises(ValueError, match="nodes"):
        solvers.power_centrality(spark.createDataFrame([*edges, (n, 0, 1.0)], "src long, dst long, w double"))


def test_cohorts_of_more_sources_than_a_word(spark, tmp_path):
    from meshlark.plans import similarity_queries

    rnd = random.Random(9)
    shared = "".join(rnd.choice("abcd") for _ in range(40))
    sources = [0, 62, 63, 64, 127, 130]
    spark.createDataFrame([(f"src{i}", shared) for i in sources], "source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, shared)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    (r,) = similarity_queries.cohort_core_accessory(spark, str(tmp_path)).collect()
    assert r.sources == len(sources)
    got = similarity_queries.cohort_coverage(spark, str(tmp_path)).collect()
    assert sorted((r.source, r.coverage, r.status) for r in got) == [(i, 1.0, "full") for i in sources]


def naive_chain(r, q, k):
    score, back = [], []
    for i in range(len(r)):
        best, at = float(k), -1
        for j in range(i):
            if r[j] < r[i] and q[j] < q[i]:
                new = score[j] + min(k, r[i] - r[j], q[i] - q[j]) - 0.1 * abs((r[i] - r[j]) - (q[i] - q[j]))
                if new > best:
                    best, at = new, j
        score.append(best), back.append(at)
    at = max(range(len(r)), key=lambda i: (score[i], -i))
    best, rows = score[at], []
    while at >= 0:
        rows.append(at)
        at = back[at]
    return best, rows[::-1]


def test_chains_look_back_to_any_anchor(monkeypatch):
    rnd = random.Random(5)
    for block in (3, 4096):
        monkeypatch.setattr(sequence, "CHAIN_BLOCK", block)
        for n in (1, 2, 40, 300):
            rows = sorted((rnd.randrange(3 * n), rnd.randrange(3 * n)) for _ in range(n))
            got = sequence.best_chain(pd.DataFrame(rows, columns=["ref_pos", "query_pos"]), 15)
            want = naive_chain([x[0] for x in rows], [x[1] for x in rows], 15)
            assert got[0] == pytest.approx(want[0]) and (block > n or got[1] == want[1] or got[0] == want[0])
    # a good predecessor behind more than a hundred poor ones
    rows = [(0, 0), (20, 20)] + [(30 + i, 1000 - i) for i in range(150)] + [(200, 200)]
    assert sequence.best_chain(pd.DataFrame(rows, columns=["ref_pos", "query_pos"]), 15)[1] == [0, 1, 152]


def test_components_of_long_paths_hubs_and_repeats(spark, monkeypatch):
    rnd = random.Random(6)
    nodes = list(range(-50, 650))
    rnd.shuffle(nodes)
    edges = [(nodes[i], nodes[i + 1]) for i in range(299)] + [(nodes[400], nodes[i]) for i in range(401, 600)] * 2 + [(nodes[3], nodes[3]), (None, nodes[4])]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, w double").repartition(5)
    ids = spark.createDataFrame([(n,) for n in nodes], "id long")
    want = {n: n for n in nodes} | dict.fromkeys(nodes[:300], min(nodes[:300])) | dict.fromkeys(nodes[400:600], min(nodes[400:600]))
    assert {r.id: r.component for r in graph.components(ids, df).collect()} == want


def test_packed_kmers_against_strings(spark):
    rnd = random.Random(2)
    seqs = ["".join(rnd.choice("ACGTN") if i % 3 else rnd.choice("ACGT") for i in range(n)) for n in (0, 2, 3, 50, 400)] + ["ACGT", None]
    want = {}
    for s in seqs:
        for i in range(len(s or "") - 2):
            kmer = s[i : i + 3]
            if set(kmer) <= set("ACGT"):
                kmer = min(kmer, kmer[::-1].translate(str.maketrans("ACGT", "TGCA")))
                want[kmer] = want.get(kmer, 0) + 1
    got = sequence.kmer_counts(spark.createDataFrame([(s,) for s in seqs], "s string").repartition(3), "s", 3).collect()
    assert {r.kmer: r.n for r in got} == want


def test_rings_find_all_k_neighbours(spark):
    rows = points(40) + [(100, 500.0, 500.0, 1.0), (101, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, q double").repartition(3)
    got = {}
    for r in spatial.knn_rings(df, df, ["x", "y"], 5, 0.3).collect():
        got.setdefault(r.l_id, []).append((r["rank"], r.r_id))
    known = [r for r in rows if r[1] is not None]
    for a in known:
        near = sorted(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, b[0]) for b in known if b[0] != a[0])[:5]
        assert [i for _, i in sorted(got[a[0]])] == [i for _, i in near]
    assert 101 not in got and len(spatial.knn_rings(df.limit(3), df.limit(3), ["x", "y"], 5, 0.3).collect()) == 6


def test_hierarchical_field_against_all_pairs(spark):
    df = spark.createDataFrame(points(120)[:120] + [(500, None, 1.0, 1.0)], "id long, x double, y double, q double")
    exact = {r.id: r for r in fields.direct_potential(df.dropna(), 0.0).collect()}
    got = {r.id: r for r in fields.hierarchical_field(df, 3, 12).collect()}
    assert set(got) == set(exact)
    for c in ("phi", "ex", "ey"):
        assert max(abs(got[i][c] - exact[i][c]) for i in exact) < 1e-3
    assert fields.hierarchical_field(df.limit(0), 3, 4).collect() == []


def test_minimizers_by_numbers_are_those_by_letters(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(letters) for _ in range(n)) for letters in ("ACGT", "A", "AC", "ACGTNé\U0001f600") for n in (0, 10, 22, 23, 60, 300)]

    def slow(s, k=15, w=8):
        grams, out = [s[i : i + k] for i in range(len(s) - k + 1)], []
        for i in range(len(grams) - w + 1):
            at = min(range(i, i + w), key=lambda j: (grams[j], j))
            if not out or out[-1] != at:
                out.append(at)
        return out

    assert [sequence.minimizer_places(s, 15, 8).tolist() for s in texts] == [slow(s) for s in texts]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "id long, s string")
    got = sorted(map(tuple, sequence.minimizers(df, "id", "s", 15, 8).collect()))
    assert got == sorted((i, at, s[at : at + 15]) for i, s in enumerate(texts) for at in slow(s))


def _shuffled_rows(spark) -> int:
    """Rows that all stages so far have written for shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = context._gateway
    stages = context._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def _jaccard_pairs(sets, least):
    pairs = ((a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b)
    return sorted(x for x in pairs if x[2] and x[2] >= least * (x[3] + x[4] - x[2]))


@pytest.mark.parametrize("least", [0.05, 0.2, 0.5, 1.0])
def test_similar_sets_in_parts_and_blocks(spark, tmp_path, monkeypatch, least):
    rng = random.Random(1)
    sets = {f"s{k}": {str(i) for i in rng.sample(range(80), rng.randint(1, 40))} for k in range(60)} | {"one": {"1"}, "two": {"1"}}
    rows = [(k, i) for k, items in sets.items() for i in items]
    spark.createDataFrame([*rows, *rows[:50], (None, "4"), ("none", None)], "k string, i string").coalesce(1).write.parquet(f"{tmp_path}/sets")
    df, want = spark.read.parquet(f"{tmp_path}/sets"), _jaccard_pairs(sets, least)
    for part_bytes, block_bytes, at_once in ((1 << 20, 1 << 20, 1 << 20), (500, 1 << 20, 50), (500, 60, 50)):
        monkeypatch.setattr(similarity, "PART_BYTES", part_bytes)
        monkeypatch.setattr(similarity, "BLOCK_BYTES", block_bytes)
        monkeypatch.setattr(similarity, "PAIRS_AT_ONCE", at_once)
        assert sorted((r.a, r.b, r.common, r.na, r.nb) for r in similarity.set_jaccard(df, "k", "i", least).collect()) == want


def test_pairs_of_unlike_sets_are_not_shuffled(spark, tmp_path):
    rng = random.Random(2)
    sets = {k: set(rng.sample(range(2000), 60)) for k in range(300)} | {300 + k: set(range(60 - k)) for k in range(3)}
    spark.createDataFrame([(k, i) for k, items in sets.items() for i in items], "k long, i long").coalesce(1).write.parquet(f"{tmp_path}/sets")
    before = _shuffled_rows(spark)
    got = similarity.set_jaccard(spark.read.parquet(f"{tmp_path}/sets"), "k", "i", 0.1).collect()
    assert sorted((r.a, r.b, r.common, r.na, r.nb) for r in got) == _jaccard_pairs(sets, 0.1)
    assert _shuffled_rows(spark) - before < 30_000  # 18000 items of sets; over 37000 pairs of sets share one

from __future__ import annotations

import random

import numpy as np
import pytest

import pyarrow as pa

from meshlark.llm import components as parts
from meshlark.llm import jaccard
from meshlark.llm.components import components, forest
from meshlark.llm.scratch import Scratch
from meshlark.llm.words import Words, scan
from tests.llm.test_packing_and_words import complementary_words


def gram_set(text, n=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, n=5, percent=75):
    sets = [gram_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least[find(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def got(df, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, **kw).collect()), key=repr)


def random_rows(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["The", "of", f"w{rnd.randint(0, 3000)}", "É"])
    common = [word() for _ in range(40)]
    rows, base = [], [[word() for _ in range(rnd.randint(1, 120))] for _ in range(25)]
    for i in range(260):
        words = list(rnd.choice(base)) if rnd.random() < 0.7 else [word() for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            if words:
                words[rnd.randrange(len(words))] = word()
        if rnd.random() < 0.3:
            words = words[: rnd.randint(0, 30)] + common
        text = rnd.choice([" ", "\n"]).join(words)
        rows.append((i, text.upper() if rnd.random() < 0.1 and text.isascii() else text))
    hub = [word() for _ in range(150)]
    for i in range(60):  # a large group of near copies that are not all similar to one another
        words = list(hub)
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(150)] = word()
        rows.append((1000 + i, " ".join(words)))
    rows += [(None, rows[0][1]), (None, None), (5, rows[9][1]), (5, rows[5][1]), (700, ""), (701, None), (702, "a b"), (703, "A  b"), (704, " \t ")]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, TEXT string").repartition(5)
    assert got(df) == brute(rows)


def test_real_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute(rows)
    assert got(df) == want
    assert sum(d != c for d, _, c in want) > 20


def test_empty(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


def test_components_of_paths_and_stars(spark):
    rnd = np.random.default_rng(1)
    nodes = rnd.permutation(400).tolist()
    edges = [(nodes[i], nodes[i + 1]) for i in range(199)] + [(nodes[200], nodes[i]) for i in range(201, 300)] + [(7, 7)]
    want = {}
    for part in (nodes[:200], nodes[200:300]):
        want |= dict.fromkeys(part, min(part))
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    found = {r.node: r.component for r in components(df, Scratch(spark, "test")).collect()}
    assert found == want
    a, b = forest(np.array([5, 4, 9]), np.array([4, 3, 8]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {4: 3, 5: 3, 9: 8}


def test_hubs_repeated_edges_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(parts, "FEW", 2)
    rnd = np.random.default_rng(2)
    nodes = (rnd.permutation(900) - 300).tolist()
    stars = [(nodes[0], nodes[i]) for i in range(1, 300)] + [(nodes[i], nodes[300]) for i in range(301, 500)]
    edges = stars * 2 + [(b, a) for a, b in stars] + [(nodes[40], nodes[310]), (None, nodes[5]), (nodes[600], None), (nodes[601], nodes[601])]
    edges += [(nodes[i], nodes[i + 7]) for i in range(700, 800)]
    df = spark.createDataFrame([(*e, 1) for e in edges], "a long, b long, A int").repartition(6)
    want = {}
    for part in [nodes[:500]] + [[nodes[i] for i in range(700 + r, 807, 7)] for r in range(7)]:
        want |= dict.fromkeys(part, min(part))
    assert {r.node: r.component for r in components(df, Scratch(spark, "test")).collect()} == want
    assert components(df.limit(0), Scratch(spark, "test")).collect() == []


def test_words_that_agree_in_plain_polynomial_hashes(spark):
    one, two = complementary_words()
    rows = [(1, one), (2, two), (3, f"{one} a b c d e f"), (4, f"{two} a b c d e f"), (5, two)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows) == [(1, 1, 1), (2, 1, 2), (3, 3, 3), (4, 3, 4), (5, 1, 2)]


def test_exact_sets_against_tuples():
    rnd = random.Random(5)
    texts = [" \t ".join(rnd.choice(["a", "b", "Cc", f"w{rnd.randint(0, 90000)}"]) for _ in range(rnd.choice([0, 1, 3, 4, 5, 6, 40, 3000]))) for _ in range(60)] + ["", " "]
    for n in (1, 2, 5):
        ((_, _, words),) = scan(pa.array(texts), lower=True)
        sets = jaccard.exact_sets(jaccard._words_of(words), n)
        want = [gram_set(t, n) for t in texts]
        assert [len(s) for s in sets] == [len(w) for w in want]
        for i in range(0, 60, 3):
            assert [len(np.intersect1d(sets[i], s)) for s in sets] == [len(want[i] & w) for w in want]
    assert [len(s) for s in jaccard.exact_sets(jaccard._words_of(Words(np.zeros(0, np.uint8), np.zeros(3, np.int64))), 5)] == [0, 0]


def test_new_hashes_where_keys_agree(spark, monkeypatch):
    rows, profile, seeds = random_rows(4), jaccard._profile, []

    def colliding(df, n, seed, slots):
        seeds.append(seed)
        found = profile(df, n, seed, slots)
        return found if seed else found.withColumn("key", found["key"] % 50)

    monkeypatch.setattr(jaccard, "_profile", colliding)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows) and seeds == [0, 1]


def test_frequent_grams_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GRAM_BLOCK", 16)
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    shared, rows = [[word() for _ in range(7)] for _ in range(3)], []
    bases = [[word() for _ in range(12)] for _ in range(60)]
    for i in range(400):  # short texts whose rare grams are the shared ones as often as their own
        words = [*shared[i % 3], *rnd.choice(bases)]
        if rnd.random() < 0.5:
            words[rnd.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    long = [word() for _ in range(30_000)]
    rows += [(1000, " ".join(long)), (1001, " ".join(long[:29_000])), (1002, " ".join([*long[:15_000], word(), *long[15_000:]]))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)

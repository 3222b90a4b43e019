from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from meshlark.llm import substrings
from tests.llm.test_packing_and_words import complementary_words


def brute(rows, k):
    """rows: (doc_id, text); for each the kept words."""
    seen = {}
    split = [(t or "").encode().split() for _, t in rows]
    rank = [float("inf") if d is None else d for d, _ in rows]
    for d, words in zip(rank, split, strict=True):
        for i in range(len(words) - k + 1):
            w = tuple(words[i : i + k])
            seen[w] = min(seen.get(w, float("inf")), d)
    out = []
    for d, words in zip(rank, split, strict=True):
        gone = set()
        for i in range(len(words) - k + 1):
            if seen[tuple(words[i : i + k])] < d:
                gone.update(range(i, i + k))
        out.append((len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return out


def random_rows(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "A", "bé", "x" * rnd.randint(1, 9), str(rnd.randint(0, 400))])
    passages = [[word() for _ in range(rnd.randint(8, 30))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 5)):
            words += rnd.choice(passages) if rnd.random() < 0.5 else [word() for _ in range(rnd.randint(0, 30))]
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(words)))
    rows += [(None, rows[3][1]), (None, rows[3][1]), (200, None), (201, ""), (202, "a " * 300), (203, "a " * 200), (5, rows[3][1]), (5, rows[4][1]), (204, "  ".join("q" * 90))]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,seed", [(7, 1), (12, 2)])
def test_against_brute_force(spark, k, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, Text string").repartition(5)
    got = [(r.n_words, r.n_removed, r.kept, r.doc_id) for r in substrings.dedup(df, min_words=k).collect()]
    want = [(*b, r[0]) for r, b in zip(rows, brute(rows, k), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[1] for r in want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.dedup(df).collect() == []


def test_real_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedup(df).collect()}
    assert got == {r[0]: b for r, b in zip(rows, brute(rows, 50), strict=True)}
    assert sum(x[1] for x in got.values()) > 0


def test_groups_are_split_by_longer_prefixes(spark):
    rows = [(i, "the " * 40 + f"w{i} " + "of " * 30) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = substrings.prefix_counts(df.select("text"), 20)
    groups = substrings.Groups(counts, 16, 20)
    assert not groups.settled[0].all() and counts[0].sum() == counts[-1].sum() == 50 * 52
    got = {r.doc_id: r.kept for r in substrings.dedup(df, min_words=20).select("doc_id", F.col("kept")).collect()}
    assert got == {i: b[2] for i, b in enumerate(brute(rows, 20))}


@pytest.mark.parametrize("k,seed", [(6, 3), (15, 4)])
def test_maximal_repeats(spark, k, seed):
    rows = [r for r in dict(reversed(random_rows(seed, 200))).items() if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in substrings.maximal_repeats(df, min_words=k).collect()]
    words, covered = {d: (t or "").split() for d, t in rows}, {}
    for d, begin, end, source, place in got:
        length = end - begin
        assert source < d and length >= k and words[d][begin:end] == words[source][place : place + length]
        covered.setdefault(d, set()).update(range(begin, end))
    assert {d: len(x) for d, x in covered.items()} == {r[0]: b[1] for r, b in zip(rows, brute(rows, k), strict=True) if b[1]}
    # neither a part of another repeat of one source nor two that could be one
    by = {}
    for d, begin, end, source, place in got:
        by.setdefault((d, source, place - begin), []).append((begin, end))
    assert all(x[1] < y[0] for spans in by.values() for x, y in zip(sorted(spans), sorted(spans)[1:]))


def test_words_that_agree_in_plain_polynomial_hashes(spark):
    one, two = complementary_words()
    rows = [(1, f"a b {one} c d"), (2, f"a b {two} c d"), (3, f"x a b {two} c d y")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=5).collect()}
    assert got == {r[0]: b for r, b in zip(rows, brute(rows, 5), strict=True)} and got[2][1] == 0 and got[3][1] == 5


def test_fingerprints_are_drawn_anew_where_words_differ(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i // 2) * 100 + j}" for j in range(30))) for i in range(20)]
    real, seeds = substrings.repeats, []

    def mistaken(df, min_words, seed):
        seeds.append(seed)
        found = real(df, min_words, seed)
        return found if seed else found.withColumn("repeats", F.transform("repeats", lambda r: r.withField("source", F.lit(4).cast("long"))))

    monkeypatch.setattr(substrings, "repeats", mistaken)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substrings.dedup(df, min_words=10).collect()}
    assert got == {i: 30 * (i % 2) for i in range(20)} and seeds == [0, 1]


def test_a_long_text_and_a_passage_in_all_documents(spark):
    rnd = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(80))
    long = " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(400_000))
    rows = [(i, f"{i} {passage} {i}") for i in range(300)] + [(1000, long), (1001, f"y {long[:900_000]} {passage} {long[900_001:]}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedup(df).collect()}
    want = {r[0]: b for r, b in zip(rows, brute(rows, 50), strict=True)}
    assert got == want and want[1001][1] > 399_000

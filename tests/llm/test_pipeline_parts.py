from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from meshlark.llm import mixing, sharding, toxicity

SOURCES = ["b", "a", None, "é", "a", "c", "a", ""]


@pytest.fixture(scope="module")
def documents(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join("w" * rnd.randint(1, 4) for _ in range(rnd.choice([0, 1, 5, 60, 400]))), SOURCES[rnd.randrange(len(SOURCES))]) for i in range(900)]
    rows += [(None, None, "a"), (None, "x y", None), (7, "x\ty  z\n", "b"), (7, "x\ty  z\n", "b"), (901, "long " * 30000, "é")]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, SOURCE int").repartition(5), rows


# ---------------------------------------------------------------- sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 1000, 4097])
def test_feistel_is_a_permutation(n):
    f = sharding.Feistel(n, 3)
    out = f.forward(np.arange(n))
    assert sorted(out.tolist()) == list(range(n))
    assert f.backward(out).tolist() == list(range(n))
    assert n < 100 or out.tolist() != sharding.Feistel(n, 4).forward(np.arange(n)).tolist()


def test_shards(documents):
    df, rows = documents
    got = sharding.shard(df, 8, seed=1).collect()
    assert len(got) == len(rows)
    want = sorted(((d is None, d or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t, _ in rows)
    by_row = sorted(got, key=lambda r: r.row_number)
    assert [((r.doc_id is None, r.doc_id or 0), r.text_crc32, r["size"]) for r in by_row] == want
    f = sharding.Feistel(len(rows), 1)
    places = f.forward(np.arange(len(rows))).tolist()
    assert [(r.shard, r.slot) for r in by_row] == [(p % 8, p // 8) for p in places]
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(rows) / 8) < 1


def test_shards_of_nothing(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 8).collect() == []


# ---------------------------------------------------------------- mixing


def test_mix_meets_its_targets(documents):
    df, rows = documents
    got = mixing.mix(df, mixing.cyclic_weights, seed=7).collect()
    again = mixing.mix(df.repartition(3), mixing.cyclic_weights, seed=7).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").encode().split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, mixing.fill_targets([size[s] for s in names], mixing.cyclic_weights(names), sum(size.values())), strict=True))
    taken = {}
    for r in got:
        s = r.sources[0]
        assert r.source_size == size[s] and math.isclose(r.target, target[s]) and r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    biggest = {s: max(len((t or "").encode().split()) for _, t, x in rows if x == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in names)


def test_repeat_gives_each_row_its_copies(documents):
    df, _ = documents
    copies = {}
    for r in mixing.mix(df, mixing.cyclic_weights, seed=7).collect():
        copies.setdefault(r.doc_id, []).append(r.copies)
    out = mixing.repeat(df, mixing.cyclic_weights, seed=7)
    assert out.columns == df.columns
    seen = {}
    for r in out.collect():
        seen[r[0]] = seen.get(r[0], 0) + 1
    assert seen == {d: sum(c) for d, c in copies.items() if sum(c)}


def test_targets_stop_at_three_times_a_size():
    assert mixing.fill_targets([10, 10, 100], [1, 2, 3], 120) == pytest.approx([22.5, 30, 67.5])
    assert mixing.fill_targets([100, 1, 1], [1, 1, 1], 102) == pytest.approx([96, 3, 3])
    assert mixing.fill_targets([50, 50], [1, 3], 100) == pytest.approx([25, 75])
    got = mixing.fill_targets([1, 1, 998], [100, 100, 1], 1000)
    assert got == pytest.approx([3, 3, 994])
    assert mixing.fill_targets([0, 5], [1, 1], 5) == pytest.approx([0, 5])


def test_flow_is_optimal_for_overlapping_sources():
    patterns = [frozenset("a"), frozenset("ab"), frozenset("b")]
    flow = mixing.min_cost_flow(patterns, [10, 10, 2], {"a": 15, "b": 10})
    into = {s: sum(w for (i, x), w in flow.items() if x == s) for s in "ab"}
    assert into == {"a": 15, "b": 10}
    used = [sum(w for (i, _), w in flow.items() if i == p) for p in range(3)]
    cost = sum(min(w, c) + 3 * min(max(w - c, 0), c) + 5 * max(w - 2 * c, 0) for w, c in zip(used, [10, 10, 2], strict=True))
    best = min(
        sum(min(w, c) + 3 * min(max(w - c, 0), c) + 5 * max(w - 2 * c, 0) for w, c in zip((15 - x, x + y, 10 - y), [10, 10, 2], strict=True))
        for x in range(16) for y in range(11) if x + y <= 30 and 10 - y <= 6
    )
    assert cost == best


def test_mixing_by_arrays_of_sources(spark):
    df = spark.createDataFrame([(i, "a b c", ["x", "y"] if i % 2 else ["x", None]) for i in range(40)], "doc_id long, text string, source array<string>")
    got = mixing.mix(df, lambda names: [1] * len(names), seed=1).collect()
    assert sum(r.taken for r in got) == pytest.approx(120, abs=6) and {tuple(r.sources) for r in got} == {("x", "y"), ("x", None)}


def test_each_source_gets_its_target_from_overlapping_documents(spark):
    rnd = random.Random(12)
    rows = [(i, " ".join(["w"] * rnd.randint(1, 30)), rnd.sample(["a", "b", "c", "d"], rnd.randint(1, 4))) for i in range(1500)]
    rows += [(2000 + i, "w " * rnd.randint(1, 30), ["small"]) for i in range(20)] + [(3000, "", ["a"]), (3001, None, None), (3002, "x y", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>").repartition(4)
    weights = {"a": 5, "b": 1, "c": 1, "d": 2, "small": 1, None: 1}
    got = mixing.mix(df, lambda names: [weights[n] for n in names], seed=3).collect()
    size, taken = {}, {}
    for r in got:
        assert r.copies == sum(x.copies for x in r.routed) <= 3 and {x.source for x in r.routed} <= set(r.sources) and r.taken == r.copies * r["size"]
        for s in r.sources:
            size[s] = size.get(s, 0) + r["size"]
        for x in r.routed:
            taken[x.source] = taken.get(x.source, 0) + x.copies * r["size"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target = mixing.fill_targets([size[s] for s in names], [weights[n] for n in names], sum(r["size"] for r in got))
    patterns = {tuple(r.sources) for r in got}
    for s, want in zip(names, target, strict=True):  # off by a document's half at each end of each route, at most
        assert abs(taken.get(s, 0) - want) <= 30 * sum(s in p for p in patterns), (s, taken, target)
    assert sum(taken.values()) == pytest.approx(sum(target), rel=0.02)


def test_too_many_patterns_raise(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 3)
    df = spark.createDataFrame([(i, "a", f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="sets of sources"):
        mixing.mix(df, mixing.cyclic_weights)


def test_mixing_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string"), mixing.cyclic_weights).collect() == []


# ---------------------------------------------------------------- toxicity


def corpus(n=600, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeimnort") for _ in range(rnd.randint(2, 8)))
    texts, toxic = [], []
    for _ in range(n):
        words = [word() for _ in range(rnd.randint(5, 300))]
        bad = rnd.random() < 0.15
        if bad:
            for _ in range(rnd.randint(2, 5)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["Scumbag", "moron,", "idiot"]))
        texts.append(" ".join(words)), toxic.append(int(bad))
    return texts, toxic


def test_classifier_on_held_out_texts():
    texts, toxic = corpus()
    model = toxicity.fit(texts, np.array(toxic))
    other, truth = corpus(400, 2)
    score = model.score(other)
    assert ((score >= 0.5) == np.array(truth)).mean() > 0.97
    assert model.score(["", None, "ab"]).tolist() == [pytest.approx(1 / (1 + math.exp(-model.intercept)))] * 3
    assert model.score([]).tolist() == []


def naive_scores(texts, toxic, others):
    """The docstring's classifier with sets of strings, dense matrices and Newton's method."""
    held = [{t.lower()[i : i + n] for n in (3, 5, 7) for i in range(len(t.lower()) - n + 1)} for t in texts]
    n1, n0, found = sum(toxic), len(toxic) - sum(toxic), []
    for gram in sorted(set().union(*held)):
        one = sum(gram in h for h, y in zip(held, toxic, strict=True) if y)
        zero = sum(gram in h for h in held) - one
        p = (one + zero) / (n1 + n0)
        spread = math.sqrt(max(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        if one + zero >= 4 and abs(one / n1 - zero / n0) / spread >= 4:
            found.append((gram, one + 1, zero + 1))
    s1, s0 = sum(f[1] for f in found), sum(f[2] for f in found)
    ratio = {g: math.log(a / s1) - math.log(b / s0) for g, a, b in found}
    row = lambda h: [ratio[g] if g in h else 0.0 for g, *_ in found] + [1.0]
    x, y = np.array([row(h) for h in held]), np.array(toxic, float)
    weight = np.where(y > 0, math.sqrt(len(y) / (2 * n1)), math.sqrt(len(y) / (2 * n0)))
    w, ridge = np.zeros(x.shape[1]), np.diag([0.3] * len(found) + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge @ w)
    look = [{t.lower()[i : i + n] for n in (3, 5, 7) for i in range(len(t.lower()) - n + 1)} for t in others]
    return 1 / (1 + np.exp(-np.array([row(h) for h in look]) @ w)), len(found)


def test_fit_against_a_naive_one():
    rnd = random.Random(21)
    alphabet = "abcé中İß😀 A"
    texts, toxic = [], []
    for _ in range(300):
        bad = rnd.random() < 0.3
        words = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(0, 12))]
        if bad:
            words.insert(rnd.randint(0, len(words)), rnd.choice(["Сволочь", "крети́н", "蠢货东西", "FOOL you"]))
        texts.append(" ".join(words)), toxic.append(int(bad))
    others = texts[:40] + ["сволочь", "a fool YOU", "", "中中中", "fool"]
    want, n = naive_scores(texts, toxic, others)
    model = toxicity.fit(texts, np.array(toxic))
    assert len(model.keys) == n > 30
    assert np.abs(model.score(others) - want).max() < 0.01


def test_scores_do_not_depend_on_pieces(monkeypatch):
    texts, toxic = corpus(200)
    whole = toxicity.fit(texts, np.array(toxic))
    score = whole.score([*texts, " ".join(texts)])
    monkeypatch.setattr(toxicity, "PIECE", 100)
    parts = toxicity.fit(texts, np.array(toxic))
    assert parts.keys.tolist() == whole.keys.tolist() and np.allclose(parts.weights, whole.weights)
    assert np.allclose(parts.score([*texts, " ".join(texts)]), score)


def test_training_in_tasks_equals_the_local_fit(spark):
    texts, toxic = corpus(400, 5)
    texts[3] = texts[3] * 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    own = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    local = toxicity.fit([texts[i] for i in own], np.array([toxic[i] for i in own]), max_features=None)
    model = toxicity.train(docs, labels, max_features=None)
    assert sorted(model.keys.tolist()) == sorted(local.keys.tolist()) and np.allclose(model.score(texts), local.score(texts), atol=1e-6)
    few = toxicity.train(docs, labels, max_train_rows=100, max_features=5)
    assert len(few.keys) <= 5
    # rows that tie at the bound all stay
    same = spark.createDataFrame([(i % 2 * 2 + 1, "idiot moron" if i % 2 else "kind words") for i in range(40)], "doc_id long, text string")
    assert toxicity.train(same, spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int"), max_train_rows=30).intercept == pytest.approx(math.log(20.5 / 20.5), abs=1) 


def test_score_query(spark):
    texts, toxic = corpus()
    rows = list(enumerate(texts)) + [(None, "idiot"), (9000, None), (9001, ""), (3, "moron moron")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, Toxic int")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(5, None), (None, 1), (77777, 1), (6, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows)
    right = total = 0
    for r in got:
        held = r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.held_out == held and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if held and r.doc_id is not None and r.doc_id < 600 and r.doc_id != 3:
            right, total = right + (r.predicted == toxic[r.doc_id]), total + 1
    assert right / total > 0.93


def test_labels_that_agree_or_are_missing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    ones = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int")
    assert min(r.score for r in toxicity.score(docs, ones).collect()) > 0.5
    assert toxicity.score(docs.limit(0), ones).collect() == []


def test_held_out_labels_change_nothing(spark):
    texts, toxic = corpus(300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    flip = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in enumerate(toxic)]
    one = {r.doc_id: r.score for r in toxicity.score(docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")).collect()}
    two = {r.doc_id: r.score for r in toxicity.score(docs, spark.createDataFrame(flip, "doc_id long, toxic int")).collect()}
    assert one == two

from __future__ import annotations

import numpy as np
import pytest

from meshlark.llm import images


def smooth(seed, size):
    rng = np.random.default_rng(seed)
    field = images._box(images._box(rng.standard_normal((1, size, size)), 2), 1)[0]
    return np.clip(128 + 45 * (field - field.mean()) / field.std(), 0, 255)


def blocks(seed, size=96):
    rng = np.random.default_rng(seed)
    return np.clip(128 + 60 * np.kron(rng.standard_normal((size // 8, size // 8)), np.ones((8, 8))), 0, 255)


def edits(base, seed):
    """Each kind of edit of an image."""
    rng, n = np.random.default_rng([seed, 99]), len(base)
    spot = base.copy()
    spot[: n // 4, : n // 4] = 255
    scaled = lambda f: images._resized(base[None], round(n * f), round(n * f))[0]
    return {
        "crop": base[n // 8 :, : 7 * n // 8], "half": base[n // 4 : 3 * n // 4 + n // 8, n // 8 : 3 * n // 4], "shade": np.clip(base * 0.8 + 20, 0, 255), "noise": np.clip(base + rng.normal(0, 3, base.shape), 0, 255),
        "turn": np.rot90(base), "cover": spot, "equal": base, "smaller": scaled(0.71), "larger": scaled(1.4),
    }


def raster(a):
    return images.to_pgm(np.rint(a).astype(np.uint8))


def results(spark, rows, partitions=None):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        if partitions:
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        df = spark.createDataFrame([(*r, 1) for r in rows], "id long, image binary, IMAGE int").repartition(4)
        found = images.copies(df, "id", "image").collect()
        assert len(found) == len(rows)
        return {r.id: r for r in found}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_recall_of_each_kind_and_no_false_links(spark):
    originals = [smooth(i, 128) for i in range(16)] + [blocks(i) for i in range(16)]
    rows, expect = [(i, raster(p)) for i, p in enumerate(originals)], {}
    for i, p in enumerate(originals):
        for k, (kind, e) in enumerate(edits(p, i).items()):
            rows.append((1000 + 20 * i + k, raster(e)))
            expect[1000 + 20 * i + k] = (kind, i)
    rows += [(900, None), (901, b"damaged"), (902, raster(np.full((64, 64), 7.0))), (903, raster(smooth(1, 128)[:9, :9])), (904, b"P5 9 9 255\n"), (None, raster(smooth(0, 128))), (1, raster(originals[1]))]
    got = results(spark, rows)
    assert [i for i in [*range(32), 900, 901, 902, 903, 904] if got[i].component_id != i or not got[i].kept] == []
    found: dict[str, list] = {}
    for i, (kind, base) in expect.items():
        assert got[i].component_id in (i, base) or expect.get(got[i].component_id, (0, -1))[1] == base
        found.setdefault(kind, []).append(got[i].component_id == base)
    recall = {kind: np.mean(x) for kind, x in found.items()}
    print(recall)
    assert min(recall.values()) >= 0.9, recall
    assert got[None].component_id == 0 and not got[None].kept
    assert got[900].n_features == got[901].n_features == got[902].n_features == 0 < got[0].n_features


def test_large_groups_of_noisy_copies_at_any_number_of_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, raster(smooth(i % 3, 64) + rng.normal(0, 4, (64, 64)))) for i in range(450)] + [(1000 + i, raster(smooth(50 + i, 64))) for i in range(50)]
    found = [{i: (r.n_features, r.component_id) for i, r in results(spark, rows, p).items()} for p in (1, 9)]
    assert found[0] == found[1]
    right = np.mean([found[0][i][1] == i % 3 for i in range(450)])
    assert right >= 0.9, right
    assert all(found[0][1000 + i][1] == 1000 + i for i in range(50))


def brute_pairs(rows):
    out = set()
    for i, (n1, s1, h1, l1, *_) in enumerate(rows):
        for n2, s2, h2, l2, *_ in rows[:i]:
            if n1 != n2 and bin((h1 ^ h2) & (2**64 - 1)).count("1") + bin((l1 ^ l2) & (2**64 - 1)).count("1") <= images.MOST_BITS:
                out.add((*min((n1, s1), (n2, s2)), *max((n1, s1), (n2, s2))))
    return out


@pytest.mark.parametrize("small", [64, 4])
def test_hamming_join_against_brute_force(spark, monkeypatch, small):
    """Pairs that share a band are found: all of them in small buckets, in large ones those with a hub or across components."""
    monkeypatch.setattr(images, "SMALL", small)
    monkeypatch.setattr(images, "BLOCK", 8)
    rng = np.random.default_rng(7)
    base, rows = rng.integers(0, 2, (12, 128)), []
    for i in range(300):
        bits = base[i % 12] ^ (rng.random(128) < rng.choice([0, 0.02, 0.06]))
        high, low = np.packbits(bits.astype(np.uint8)).view(">u8").astype(np.uint64).view(np.int64).tolist()
        rows.append((i // 2, i % 2, high, low, i // 2 % 5))
    df = spark.createDataFrame([r[:4] for r in rows], "node long, spot int, high long, low long").repartition(3)
    words = lambda r: [(k, w >> s & 0xFFFF) for k, (w, s) in enumerate((x, s) for x in r[2:4] for s in (48, 32, 16, 0))]
    of = {(r[0], r[1]): (set(words(r)), r) for r in rows}
    near = {p for p in brute_pairs(rows) if of[p[:2]][0] & of[p[2:]][0]}
    from pyspark.sql import functions as F

    bucketed = images._bucketed(df, len(rows))
    end = lambda f: f(F.struct("node", "spot", "high", "low"))
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("n"), end(F.min).alias("least"), end(F.max).alias("greatest")).filter("n > 1")
    first = {tuple(r) for r in images._first_matches(bucketed, sizes, 5).collect()}
    group = spark.createDataFrame([(r[0], r[4]) for r in rows if r[1] == 0], "node long, component long")
    more = {tuple(r) for r in images._further_matches(bucketed, sizes, group, 5).collect()}
    assert first <= near and more <= near and len(near) > 500
    component = {r[0]: r[4] for r in rows}
    across = {p for p in near if component[p[0]] != component[p[2]]}
    assert first == near if small == 64 else across <= first | more and len(first) < len(near)
    # fewer differing bits than bands: always found
    sure = {p for p in brute_pairs(rows) if sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(of[p[:2]][1][2:4], of[p[2:]][1][2:4], strict=True)) < 8}
    assert sure <= near


def test_empty(spark):
    assert images.copies(spark.createDataFrame([], "id long, image binary"), "id", "image").collect() == []


def test_long_vectors_and_odd_ones_are_drawn():
    import pyarrow as pa

    got = images.draw_vectors(pa.array([[1.0, 2.0, 3.0], None, [], [1.0, None], [float("nan"), 1.0], [2.0, 2.0], list(range(500))], pa.list_(pa.float64()))).to_pylist()
    assert [g is None for g in got] == [False, True, True, True, True, True, False] and images.from_pgm(got[6]).shape == (80, 80)


def test_bands_do_not_depend_on_the_number_of_features(spark):
    high, low = 0x0123456789ABCDEF, 0x0FEDCBA987654321
    one = spark.createDataFrame([(7, 0, high, low)], "node long, spot int, high long, low long")
    want = [(k << 16) + ((high << 64 | low) >> (112 - 16 * k) & 0xFFFF) for k in range(8)]
    assert sorted(r.bucket for r in images._bucketed(one).collect()) == want
    assert not hasattr(images, "band_bits")


def test_features_of_large_buckets_are_shuffled_once(spark):
    rng = np.random.default_rng(5)
    n, values = 2000, rng.integers(0, 1 << 16, (8, 4))
    bands = np.take_along_axis(values, rng.integers(0, 4, (8, n)), 1).astype(np.uint64)  # buckets of some 500 features
    high, low = ((w[0] << np.uint64(48) | w[1] << np.uint64(32) | w[2] << np.uint64(16) | w[3]).view(np.int64) for w in (bands[:4], bands[4:]))
    found = spark.createDataFrame([(i, 0, int(a), int(b)) for i, (a, b) in enumerate(zip(high, low, strict=True))], "node long, spot int, high long, low long")
    component = np.where(np.arange(n) < 1000, np.arange(n) // 2 * 2, np.arange(n))
    group = spark.createDataFrame([(i, int(c)) for i, c in enumerate(component[:1000])], "node long, component long")
    i, j = np.nonzero(np.triu(images._apart(high.view(np.uint64), low.view(np.uint64), np.arange(n)[:, None], np.arange(n)[None, :]) <= images.MOST_BITS, 1))
    want = {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if component[a] != component[b]}
    sizes = spark.createDataFrame([(int(k << 16 | v), int(m)) for k in range(8) for v, m in zip(*np.unique(bands[k], return_counts=True), strict=True)], "bucket long, n long")
    before = shuffled_rows(spark)
    got = images._further_matches(images._bucketed(images._grouped(found, group)), sizes, None, 4).collect()
    assert {(r.a_node, r.b_node) for r in got} == want and len(want) > 500
    assert shuffled_rows(spark) - before < 30_000  # each feature once for each of eight bands, and twice for its component


@pytest.mark.parametrize("most", [1 << 22, 50])
def test_single_matches_of_unlike_images_make_no_rows(spark, monkeypatch, most):
    """Of all matches between components exactly those of image pairs with enough of them, whatever the blocks and the matches held."""
    monkeypatch.setattr(images, "BLOCK", 64)
    monkeypatch.setattr(images, "MOST_MATCHES", most)
    monkeypatch.setattr(images, "DENSE", 16)
    rng = np.random.default_rng(11)
    common = rng.integers(0, 2, (6, 128))  # looks that all images share: one match for many pairs
    looks = rng.integers(0, 2, (40, 8, 128))  # and those of 40 groups of four images
    rows = []
    for node in range(160):
        bits = [common[rng.integers(6)], *looks[node % 40]]
        for spot, b in enumerate(bits):
            high, low = np.packbits((b ^ (rng.random(128) < 0.02)).astype(np.uint8)).view(">u8").astype(np.uint64).view(np.int64).tolist()
            rows.append((node, spot, high, low, node % 80))  # half of each group is one component already
    words = lambda r: {(k, w >> s & 0xFFFF) for k, (w, s) in enumerate((x, s) for x in r[2:4] for s in (48, 32, 16, 0))}
    of = {r[:2]: words(r) for r in rows}
    across = {p for p in brute_pairs(rows) if of[p[:2]] & of[p[2:]] and p[0] % 80 != p[2] % 80}
    count: dict[tuple, int] = {}
    for a, _, b, _ in across:
        count[a, b] = count.get((a, b), 0) + 1
    want = {p for p in across if count[p[0], p[2]] >= 4}
    df = spark.createDataFrame(rows, "node long, spot int, high long, low long, component long").repartition(3)
    got = [tuple(r) for r in images._further_matches(df, None, None, 4, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert 500 < len(want) < len(across) / 2


def shuffled_rows(spark) -> int:
    """Rows that all stages so far have written for shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = context._gateway
    stages = context._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

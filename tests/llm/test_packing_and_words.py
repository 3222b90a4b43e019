from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshlark.llm.packing import pack, partition_keys, unpack, unzigzag, zigzag
from meshlark.llm import words as words_module
from meshlark.llm.words import PRIME, Runs, Words, buffers, scan, times


@given(st.lists(st.lists(st.integers(0, 2**64 - 1), max_size=20), max_size=4))
def test_pack_round_trip(lists):
    arrays = [np.array(x, np.uint64) for x in lists]
    assert [x.tolist() for x in unpack(pack(*arrays))] == lists


@given(st.lists(st.integers(-(2**63), 2**63 - 1)))
def test_zigzag(values):
    assert unzigzag(zigzag(np.array(values, np.int64))).tolist() == values


def test_partition_keys_reach_their_partitions(spark):
    for n in (1, 3, 50):
        keys = partition_keys(n)
        df = spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)], "k int, want int").repartition(n, "k")
        assert all(r.want == r.got for r in df.select("want", F.spark_partition_id().alias("got")).collect())


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\x0c\r\x1c\xa0éA", max_size=30)), max_size=12), st.integers(1, 4))
def test_words_are_those_of_bytes_split(texts, k):
    column = pa.array(texts, pa.string())
    for sliced in (column, column.slice(len(texts) // 2)):
        seen = []
        for i, j, words in scan(sliced, lower=True, most=16):
            own = [(t or "").encode().lower().split() for t in sliced.to_pylist()[i:j]]
            found = [words.data[s:e].tobytes() for s, e in zip(words.starts, words.ends, strict=True)]
            assert found == [w for x in own for w in x] and words.counts.tolist() == [len(x) for x in own]
            at = words.places(k)
            runs = [tuple(x[n : n + k]) for x in own for n in range(len(x) - k + 1)]
            assert len(at) == len(runs)
            seen += list(zip(runs, words.runs(k).of(at, at + k).tolist(), strict=True))
        assert len(dict(seen)) == len(set(seen)) == len({h for _, h in seen})


def test_long_words_and_texts_cross_the_blocks_of_hashing():
    word = "x" * 700_000
    text = f"{word} y {word} " + "ab c " * 300_000
    ((_, _, words),) = scan(pa.array([text]))
    h = words.hashes()
    assert h[0] == h[2] != h[1] and h[3] == h[5] == h[-2] and len(words.starts) == 600_003
    runs = words.runs(50).of(np.array([3, 5, 6, 600_001 - 50]), np.array([53, 55, 56, 600_001]))
    assert runs[0] == runs[1] == runs[3] != runs[2]


def test_buffers_of_null_and_large_arrays():
    for kind in (pa.string(), pa.large_string(), pa.binary()):
        data, offsets = buffers(pa.array(["ab", None, "", "c"], kind) if kind != pa.binary() else pa.array([b"ab", None, b"", b"c"], kind))
        assert data.tobytes() == b"abc" and offsets.tolist() == [0, 2, 2, 2, 3]
    assert len(Words(np.zeros(0, np.uint8), np.zeros(1, np.int64))) == 0


def complementary_words():
    """Words of 1024 letters whose polynomial hashes modulo a power of two are equal at every odd point."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_hashes_of_complementary_words_differ():
    ((_, _, words),) = scan(pa.array([" ".join(complementary_words())]))
    for seed in range(4):
        one, two = words.hashes(seed).tolist()
        assert one != two


@given(st.integers(0, PRIME - 1), st.integers(0, PRIME - 1))
def test_products_modulo_the_prime(a, b):
    assert int(times(np.array([a], np.uint64), np.array([b], np.uint64))[0]) == a * b % PRIME


def test_runs_are_polynomials_across_blocks(monkeypatch):
    monkeypatch.setattr(words_module, "_BLOCK", 64)
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, PRIME, 500).astype(np.uint64), rng.integers(0, 256, 500).astype(np.uint8)):
        found = Runs(values, 50, 3)
        point, plus = int(found.up[1]), int(values.dtype == np.uint8)
        starts = np.array([0, 63, 64, 100, 449, 499])
        ends = np.minimum(starts + [50, 50, 1, 0, 50, 50], 500)
        want = [sum((int(values[i]) + plus) * pow(point, i - s, PRIME) for i in range(s, e)) % PRIME for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        assert found.of(starts, ends).tolist() == want

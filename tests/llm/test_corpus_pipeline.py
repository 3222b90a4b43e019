"""Each stage against a brute-force version of it, on what the stage before it kept."""

from __future__ import annotations

from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from meshlark.llm import byte_bpe, mixing, toxicity
from tests.llm.test_jaccard import brute as linked
from tests.llm.test_substrings import brute as cut

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before, [r.asDict() for r in docs.collect()])
        assert name == "byte_bpe" or docs.columns == columns

    before, after = kept["toxicity"]
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    score = model.score([r["text"] for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r, s in zip(before, score, strict=True) if s < 0.5)

    before, after = kept["ngram_jaccard"]
    component = linked([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, _, c in component if d == c)
    assert len(after) < len(before)

    before, after = kept["substring_dedup"]
    want = cut([(r["doc_id"], r["text"]) for r in before], 50)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after} == {r["doc_id"]: (k, len(k)) if n else (r["text"], r["n_chars"]) for r, (_, n, k) in zip(before, want, strict=True)}

    before, after = kept["mixture"]
    size = Counter()
    for r in before:
        size[r["source"]] += len(r["text"].split())
    names = sorted(size)
    target = dict(zip(names, mixing.fill_targets([size[s] for s in names], mixing.cyclic_weights(names), sum(size.values())), strict=True))
    taken = Counter()
    for r in after:
        taken[r["source"]] += len(r["text"].split())
    biggest = {s: max(len(r["text"].split()) for r in before if r["source"] == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in names)
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3
    texts = {r["doc_id"]: r for r in before}
    assert all(texts[r["doc_id"]] == r for r in after)

    before, after = kept["byte_bpe"]
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter((r["doc_id"], tuple(coder.encode_ordinary(r["text"]))) for r in before)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in after) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in after)


def test_run_equals_the_stages(spark):
    first, again = (sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert first == again and first


def clashing(spark, rows):
    """The columns of documents and further ones whose names clash with each other and with what operators add."""
    extra = ["TEXT", "_score", "_cut", "Doc_ID", "component_id", "text_hash", "_in0", "_copy"]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    return spark.createDataFrame([(*r[:2], "en", r[2], len(r[1] or ""), *["x"] * len(extra)) for r in rows], kinds).repartition(3)


def odd_rows():
    words = " ".join(f"w{i}" for i in range(120))
    long = " ".join(f"v{i % 9973} z{i}" for i in range(300_000))
    rows = [(1, words, "a"), (2, words, "a"), (2, words, "a"), (2, "another text of the same id", None), (None, words, "b"), (None, None, "b"), (3, None, "a"), (4, "", None), (4, "", None)]
    return rows + [(5, f"{words} {words.replace('w', 'u')}", "b"), (6, long, "a"), (7, long, "b"), (8, "short", "b"), (8, "short", "b"), (9, f"before {words.replace('w', 'k')} {words.replace('w', 'u')}", None)]


def test_stages_on_odd_tables(spark, tmp_path):
    spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = odd_rows()
    docs = clashing(spark, rows)
    ids = lambda df: sorted(((r[0], r[1]) for r in df.collect()), key=repr)
    kept = stages["toxicity"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and ids(kept) == ids(docs)
    text = {i: t for i, t, _ in rows if i is not None}
    words = text[1]
    single = stages["ngram_jaccard"](spark, docs, str(tmp_path))
    want = [(1, words), (None, words), (None, None), (3, None), (4, ""), (4, ""), (2, "another text of the same id"), (5, text[5]), (6, text[6]), (8, "short"), (9, text[9])]
    assert single.columns == docs.columns and ids(single) == sorted(want, key=repr)
    trimmed = stages["substring_dedup"](spark, single, str(tmp_path))
    assert trimmed.columns == docs.columns
    found = {(r[0], r[1]): r[4] for r in trimmed.collect()}
    u, k = words.replace("w", "u"), words.replace("w", "k")
    assert found[5, u] == len(u) and found[9, f"before {k}"] == len(f"before {k}") and (None, "") in found and (None, None) in found and (6, text[6]) in found
    mixed = stages["mixture"](spark, trimmed, str(tmp_path))
    assert mixed.columns == docs.columns and max(Counter(map(tuple, mixed.collect())).values()) <= 3
    tokens = stages["byte_bpe"](spark, docs, str(tmp_path)).collect()
    assert len(tokens) == len(rows) and {r.n_tokens for r in tokens if r.doc_id in (3, 4)} == {0}
    nothing = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, nothing, str(tmp_path))
        assert got.collect() == [] and (name == "byte_bpe" or got.columns == docs.columns)


def test_run_keeps_further_columns_to_the_last_stage(spark, tmp_path):
    rows = [(i, f"text number {i} of some words", "a") for i in range(12)] + [(3, "x", None)]
    docs = clashing(spark, rows)
    docs.toDF(*[f"x{c}" if c in ("TEXT", "Doc_ID") else c for c in docs.columns]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= set(range(12))

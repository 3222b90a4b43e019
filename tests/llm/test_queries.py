"""The registered queries return the columns that are asked for, a row for each row of their tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from meshlark.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_token_counts": {"doc_id": "bigint", "n_tokens": "bigint"},
    "op2_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op3_ngram_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op4_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_vector_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op7_mixture": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8_image_copies": {"vec_id": "bigint", "n_features": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
}


def test_all_are_registered():
    assert set(queries.queries()) == set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    got = queries.queries()[name](spark, SF)
    assert COLUMNS[name].items() <= dict(got.dtypes).items()
    table, key = ("embeddings", "vec_id") if "vec_id" in COLUMNS[name] else ("documents", "doc_id")
    want = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in got.select(key).collect()) == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    database = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        database.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cursor = database.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(cursor.fetchall())

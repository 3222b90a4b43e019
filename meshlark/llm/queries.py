"""The subpackage's queries: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm import byte_bpe, images, jaccard, mixing, sharding, substrings, token_files, toxicity, vector_dedup

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The id that ends a document in op1's files: the vocabulary's own end of text, which no ordinary text yields.
FLAT_END = 50256
SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER, FLAT_END)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), TOKENIZER, end_id=2)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), SHARDS, seed=20)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), mixing.cyclic_weights, seed=7)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images, so each row of ``embeddings`` is drawn as one; near vectors make edited copies."""
    vectors = table(spark, sf_dir, "embeddings")
    drawn = vectors.select("vec_id", images.draw_udf("embedding").alias("image"))
    return images.copies(drawn, "vec_id", "image").withColumnRenamed("id", "vec_id")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: All pairs of one label by cosine; components by walking links. DuckDB takes seconds for the test tables' labels.
OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.r AS r, b.r AS s FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT r, r AS s FROM v
  UNION
  SELECT reach.r, link.s FROM reach JOIN link ON reach.s = link.r
), least AS (
  SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.s = v.r GROUP BY reach.r
)
SELECT v.vec_id AS vec_id, (SELECT count(*) FROM link WHERE link.r = v.r) AS n_links, component_id,
  coalesce(v.vec_id = component_id, false) AS kept
FROM v JOIN least ON v.r = least.r
"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Sets of real shingles, their common ones counted by a join, components by walking links.
OP3_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT r, count(*) AS n FROM g GROUP BY r
), same AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2
), link AS (
  SELECT a, b FROM same JOIN n x ON x.r = a JOIN n y ON y.r = b JOIN d p ON p.r = a JOIN d q ON q.r = b
  WHERE 100 * c >= 75 * (x.n + y.n - c) AND p.doc_id IS NOT NULL AND q.doc_id IS NOT NULL
), ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT r, r AS s FROM d
  UNION
  SELECT reach.r, ways.b FROM reach JOIN ways ON reach.s = ways.a
)
SELECT x.doc_id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(y.doc_id) AS component_id
FROM reach JOIN d x ON x.r = reach.r JOIN d y ON y.r = reach.s LEFT JOIN n ON n.r = reach.r GROUP BY reach.r, x.doc_id
"""

#: Windows of real words, each with the least doc_id that it starts in; a null doc_id ranks last.
OP10_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), v AS (
  SELECT r, k, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), hit AS (
  SELECT r, i FROM (SELECT r, i, k, min(k) OVER (PARTITION BY s) AS least FROM v) WHERE k > least
), word AS (
  SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d
), mark AS (
  SELECT word.r, word.i, x, count(hit.i) OVER (PARTITION BY word.r ORDER BY word.i ROWS 49 PRECEDING) > 0 AS gone FROM word LEFT JOIN hit ON hit.r = word.r AND hit.i = word.i
), kept AS (
  SELECT r, count(*) AS n, count(*) FILTER (gone) AS gone, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM mark GROUP BY r
)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.r = d.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard": OP3_SQL, "op5_vector_dedup": OP5_SQL, "op10_substring_dedup": OP10_SQL}

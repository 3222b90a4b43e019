"""A corpus pipeline of five stages, each on all that the one before it kept.

Each function takes (spark, docs, sf_dir) and returns the documents that go on, the last one their tokens. Columns are
found by exact spelling and kept by place, so further columns, also of clashing names, go through all stages but the last.

Results for special input, by stage (each of them takes texts of any length whole, and an empty table gives no rows):

- ``drop_toxic``: null and empty texts get the score of the classifier's intercept; rows that share a doc_id are judged
  each by its text; a null doc_id is scored like any other; without labels every document stays.
- ``drop_near_copies``: null and empty texts and rows of a null doc_id are linked with nothing and all stay. Of a group the
  text of least doc_id stays, of several texts of that doc_id the one of least hash; of rows equal in doc_id and text one
  stays, whose further columns have the least hash. Rows of one doc_id but different texts are judged apart.
- ``drop_repeated_passages``: a null text stays null; a null doc_id ranks above all others; repeated rows are treated alike
  and nothing is cut for a passage that only rows of one doc_id share. A text that loses words is what is left joined by
  single spaces, possibly empty, and its ``n_chars``, if there is such a column, is counted again.
- ``mix_sources``: null and empty texts have no size and are never taken; a null source is a source of its own; repeated
  rows are taken alike.
- ``tokenize``: a null text has no ids; each row, repeated or not, gives a row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm import byte_bpe, jaccard, mixing, substrings, toxicity
from meshlark.llm.scratch import Scratch, by_place, place_of


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = toxicity.scorer(spark, model)
    return by_place(docs).filter(score(place_of(docs, "text")) < 0.5).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar n-gram sets the one of least doc_id stays."""
    scratch = Scratch(spark, "copies")
    linked = scratch.write(jaccard.join(docs).filter("n_shingles > 0 and doc_id is not null"), "linked")
    first = linked.filter("doc_id = component_id").groupBy("component_id").agg(F.min("text_hash").alias("stays"))
    texts = linked.groupBy("doc_id", "text_hash", "component_id").agg(F.count("*").alias("n")).join(first.hint("merge"), "component_id")
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("stays"))
    key = [F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")]
    gone, repeated = texts.filter(~stays).select(*key), scratch.write(texts.filter(stays & (F.col("n") > 1)).select(*key), "repeated")
    flat = by_place(docs)
    same = (F.col(place_of(docs, "doc_id")) == F.col("_doc")) & (F.xxhash64(place_of(docs, "text")) == F.col("_hash"))
    kept = flat.join(gone.hint("merge"), same, "left_anti")
    if not repeated.isEmpty():
        row = F.struct(*flat.columns)
        twice = kept.join(repeated.hint("merge"), same).groupBy("_doc", "_hash").agg(F.min_by(row, F.xxhash64(*flat.columns)).alias("row"))
        kept = kept.join(repeated.hint("merge"), same, "left_anti").union(twice.select("row.*"))
    return kept.toDF(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document of smaller doc_id holds go; other texts stay as they are."""
    out = by_place(substrings.cut(docs))
    cut = out.columns[-1]
    new = {"text": F.col(f"{cut}.kept"), "n_chars": F.length(f"{cut}.kept")}
    columns = []
    for name, place in zip(docs.columns, out.columns[:-1], strict=True):
        column = F.col(place)
        if name in new and place == place_of(docs, name):
            column = F.when(F.col(f"{cut}.n_removed") > 0, new[name].cast(out.schema[place].dataType)).otherwise(column)
        columns.append(column.alias(name))
    return out.select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the sources' target weights ask, up to three times."""
    return mixing.repeat(docs, mixing.cyclic_weights, seed=7)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document of the mixture."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mixture", mix_sources),
    ("byte_bpe", tokenize),
]

#: No stage but the mixing rule has a plain SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

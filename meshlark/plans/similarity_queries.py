"""Queries over vectors, strings and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.functions import text, vectors
from meshlark.operators import sequence, similarity
from meshlark.plans.registry import query
from meshlark.session import table

PLANES = vectors.planes(10, 64)
TABLES = [vectors.planes(8, 64, salt) for salt in (1, 5, 11)]


def _bucket_sql(planes) -> str:
    return " + ".join(f"(CASE WHEN list_dot_product(e, {p}::DOUBLE[]) > 0 THEN {1 << h} ELSE 0 END)" for h, p in enumerate(planes))


EMB = "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(f"""{EMB}, s AS (SELECT q.id AS q_id, v.id AS id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN v ON q.id <> v.id WHERE q.id % 100 = 0)
SELECT q_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "embeddings")
    out = similarity.search_exact(base, base.filter("vec_id % 100 = 0"), 10)
    return out.select("q_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"{EMB} SELECT CAST({_bucket_sql(PLANES)} AS BIGINT) AS bucket, count(*) AS n, min(id) AS first FROM v GROUP BY 1")
def lsh_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").groupBy(vectors.sign_bucket(F.col("embedding"), PLANES).alias("bucket")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


@query(f"""{EMB}, b AS (SELECT *, CAST({_bucket_sql(PLANES)} AS BIGINT) AS bucket FROM v),
p AS (SELECT id AS q_id, e AS q, xor(bucket, f) AS bucket FROM b, (SELECT unnest([0, 1, 2, 4, 8, 16, 32])::BIGINT AS f) WHERE id % 100 = 0),
s AS (SELECT q_id, b.id AS id, list_cosine_similarity(q, e) AS score FROM p JOIN b USING (bucket) WHERE q_id <> b.id)
SELECT q_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def lsh_multiprobe_topk(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "embeddings")
    out = similarity.search_lsh(base, base.filter("vec_id % 100 = 0"), PLANES, 6, 10)
    return out.select("q_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""{EMB}, k AS ({" UNION ALL ".join(f"SELECT id, {t} AS t, CAST({_bucket_sql(p)} AS BIGINT) AS b FROM v" for t, p in enumerate(TABLES))}),
c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.t = y.t AND x.b = y.b AND x.id <> y.id),
s AS (SELECT c.a, c.b, list_cosine_similarity(x.e, y.e) AS score FROM c JOIN v x ON c.a = x.id JOIN v y ON c.b = y.id)
SELECT a, b, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM s) WHERE rank <= 5""")
def knn_graph_multitable(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.knn_graph_lsh(table(spark, sf, "embeddings"), TABLES, 5).select("a", "b", F.round("score", 6).alias("score"), "rank")


@query("""
WITH g AS (SELECT unnest(CASE WHEN length(p_name) >= 3 THEN list_transform(range(1, length(p_name) - 1), lambda i: substring(p_name, i, 3)) ELSE [p_name] END) AS gram FROM part)
SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def qgram_profile(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.explode(text.grams(F.col("p_name"), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("""
WITH w AS (SELECT DISTINCT p_name AS word FROM part),
p AS (SELECT word, gram, count(*) AS n FROM (SELECT word, unnest(CASE WHEN length(word) >= 3 THEN list_transform(range(1, length(word) - 1), lambda i: substring(word, i, 3)) ELSE [word] END) AS gram FROM w) GROUP BY 1, 2),
t AS (SELECT word, sum(n) AS total FROM p GROUP BY 1),
s AS (SELECT x.word AS a, y.word AS b, sum(least(x.n, y.n)) AS shared FROM p x JOIN p y ON x.gram = y.gram AND x.word < y.word GROUP BY 1, 2)
SELECT a, b, CAST((ta.total + tb.total - 2 * shared) / 6.0 AS DOUBLE) AS bound, CAST(levenshtein(a, b) AS INT) AS distance
FROM s JOIN t ta ON a = ta.word JOIN t tb ON b = tb.word""")
def qgram_lower_bound(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.qgram_bounds(table(spark, sf, "part").select(F.col("p_name").alias("word")).distinct(), 3)


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,7}')) AS word FROM benchmark)
SELECT a.word AS l_word, b.word AS r_word, CAST(levenshtein(a.word, b.word) AS INT) AS distance FROM w a JOIN w b ON abs(length(a.word) - length(b.word)) <= 1 AND levenshtein(a.word, b.word) <= 1""")
def fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of 4 to 7 letters, as its SQL cuts them; ``fuzzy_words`` compares whole words."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,7}"), 0)).alias("word")).distinct()
    return similarity.fuzzy_join(words, words)


@query()
def fuzzy_words(spark: SparkSession, sf: str) -> DataFrame:
    """Whole words of any letters and length within two edits."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]+"), 0)).alias("word")).distinct()
    return similarity.fuzzy_join(words, words, 2)


@query("""
WITH s AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS i FROM lineitem), n AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.k AS a, y.k AS b, count(*) AS common FROM s x JOIN s y ON x.i = y.i AND x.k < y.k GROUP BY 1, 2)
SELECT a, b, common, round(common / (na.n + nb.n - common), 8) AS jaccard FROM c JOIN n na ON a = na.k JOIN n nb ON b = nb.k WHERE common / (na.n + nb.n - common) >= 0.1""")
def set_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.set_jaccard(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", 0.1).select("a", "b", "common", F.round("jaccard", 8).alias("jaccard"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45) GROUP BY 1")
def membership_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "lineitem").filter("l_quantity >= 45").select("l_orderkey")
    orders = table(spark, sf, "orders")
    return orders.join(keys, orders.o_orderkey == keys.l_orderkey, "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 40")
def frequency_heavy_hitters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).filter("n >= 40")


DNA = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
KMERS = "unnest(list_transform(range(1, length(s) - {k} + 2), lambda i: substring(s, i, {k})))"
CANON = "least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA')))"


def dna(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name).withColumn("s", text.as_dna(F.col("text")))


@query(f"WITH d AS (SELECT {DNA} AS s FROM documents), k AS (SELECT {KMERS.format(k=7)} AS kmer FROM d) SELECT {CANON} AS kmer, count(*) AS n FROM k GROUP BY 1")
def kmer_count(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.kmer_counts(dna(spark, sf, "documents"), "s", 7)


@query(f"WITH d AS (SELECT {DNA} AS s FROM benchmark), k AS (SELECT {KMERS.format(k=5)} AS kmer FROM d), c AS (SELECT {CANON} AS kmer, count(*) AS n FROM k GROUP BY 1) SELECT n, count(*) AS kmers FROM c GROUP BY 1")
def kmer_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.kmer_counts(dna(spark, sf, "benchmark"), "s", 5).groupBy("n").agg(F.count("*").alias("kmers"))


def _minimizer_sql(name: str, key: str, k: int, w: int) -> str:
    return f"""SELECT key, pos, kmer FROM (SELECT *, lag(pos) OVER (PARTITION BY key ORDER BY i) AS before FROM (
  SELECT key, i, full_, m.pos AS pos, m.kmer AS kmer FROM (
    SELECT key, i, count(*) OVER x AS full_, min({{'kmer': kmer, 'pos': i}}) OVER x AS m FROM (
      SELECT {key} AS key, unnest(range(0, length(s) - {k - 1})) AS i, {KMERS.format(k=k)} AS kmer FROM (SELECT {key}, {DNA} AS s FROM {name}))
    WINDOW x AS (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING))) WHERE full_ = {w}) WHERE before IS NULL OR before <> pos"""


@query(f"SELECT key AS item_id, CAST(pos AS INT) AS pos, kmer FROM ({_minimizer_sql('benchmark', 'item_id', 11, 5)})")
def minimizers(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.minimizers(dna(spark, sf, "benchmark"), "item_id", "s", 11, 5).select("item_id", "pos", "kmer")


def _hits(spark: SparkSession, sf: str, most: int | None = None) -> DataFrame:
    refs = sequence.minimizers(dna(spark, sf, "documents"), "doc_id", "s", 15, 8).withColumnRenamed("doc_id", "ref")
    items = sequence.minimizers(dna(spark, sf, "benchmark"), "item_id", "s", 15, 8).withColumnRenamed("item_id", "query")
    return sequence.seed_hits(refs, items, most)


@query(f"""WITH r AS ({_minimizer_sql('documents', 'doc_id', 15, 8)}), q AS ({_minimizer_sql('benchmark', 'item_id', 15, 8)}),
rare AS (SELECT kmer FROM r GROUP BY 1 HAVING count(*) <= 50)
SELECT q.key AS query, r.key AS ref, count(*) AS hits, CAST(min(r.pos) AS INT) AS first FROM q JOIN rare USING (kmer) JOIN r USING (kmer) GROUP BY 1, 2""")
def minimizer_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of rare seeds, up to 50 places as its SQL states; ``minimizer_hits_all`` has those of all."""
    return _hits(spark, sf, 50).groupBy("query", "ref").agg(F.count("*").alias("hits"), F.min("ref_pos").alias("first"))


@query(f"""WITH r AS ({_minimizer_sql('documents', 'doc_id', 15, 8)}), q AS ({_minimizer_sql('benchmark', 'item_id', 15, 8)})
SELECT q.key AS query, r.key AS ref, count(*) AS hits, CAST(min(r.pos) AS INT) AS first FROM q JOIN r USING (kmer) GROUP BY 1, 2""")
def minimizer_hits_all(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).groupBy("query", "ref").agg(F.count("*").alias("hits"), F.min("ref_pos").alias("first"))


@query()
def chain_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.chain(_hits(spark, sf), 15)


SOURCE_INDEX = "CAST(substring(source, 4) AS INT)"


@query(f"""WITH d AS (SELECT {SOURCE_INDEX} AS i, {DNA} AS s FROM documents), k AS (SELECT i, {KMERS.format(k=9)} AS kmer FROM d),
b AS (SELECT {CANON} AS kmer, bit_or(CAST(1 AS BIGINT) << i) AS samples FROM k GROUP BY 1)
SELECT CAST(bit_count(samples) AS INT) AS sources, count(*) AS kmers FROM b GROUP BY 1""")
def cohort_core_accessory(spark: SparkSession, sf: str) -> DataFrame:
    bits = sequence.cohort_bits(dna(spark, sf, "documents"), F.substring("source", 4, 9).cast("int"), "s", 9)
    held = bits.groupBy("kmer").agg(F.sum(F.bit_count("samples")).cast("int").alias("sources"))
    return held.groupBy("sources").agg(F.count("*").alias("kmers"))


@query(f"""WITH d AS (SELECT {SOURCE_INDEX} AS i, {DNA} AS s FROM documents), k AS (SELECT i, {KMERS.format(k=12)} AS kmer FROM d),
p AS (SELECT DISTINCT i, {CANON} AS kmer FROM k), u AS (SELECT DISTINCT item_id, {CANON} AS kmer FROM (SELECT item_id, {KMERS.format(k=12)} AS kmer FROM (SELECT item_id, {DNA} AS s FROM benchmark))),
t AS (SELECT item_id, count(*) AS n FROM u GROUP BY 1)
SELECT u.item_id AS item_id, p.i AS source, round(count(*) / any_value(t.n), 6) AS coverage,
  CASE WHEN count(*) / any_value(t.n) >= 0.95 THEN 'full' WHEN count(*) / any_value(t.n) >= 0.5 THEN 'partial' ELSE 'absent' END AS status
FROM u JOIN p USING (kmer) JOIN t ON u.item_id = t.item_id GROUP BY 1, 2""")
def cohort_coverage(spark: SparkSession, sf: str) -> DataFrame:
    bits = sequence.cohort_bits(dna(spark, sf, "documents"), F.substring("source", 4, 9).cast("int"), "s", 12)
    own = dna(spark, sf, "benchmark").select("item_id", F.explode(text.kmers(F.col("s"), 12)).alias("k")).select("item_id", text.canonical(F.col("k")).alias("kmer")).distinct()
    total = own.groupBy("item_id").agg(F.count("*").alias("total"))
    hits = own.join(bits, "kmer").withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(sequence.WORD - 1)))).filter(F.call_function("shiftright", "samples", F.col("bit")).bitwiseAND(1) == 1)
    hits = hits.withColumn("source", F.col("word") * sequence.WORD + F.col("bit"))
    out = hits.groupBy("item_id", "source").agg(F.count("*").alias("n")).join(total, "item_id").withColumn("x", F.col("n") / F.col("total"))
    status = F.when(F.col("x") >= 0.95, "full").when(F.col("x") >= 0.5, "partial").otherwise("absent")
    return out.select("item_id", "source", F.round("x", 6).alias("coverage"), status.alias("status"))


GUIDE = "ACGATACCAG"


@query(f"""WITH k AS (SELECT doc_id, CAST(unnest(range(0, length(s) - 11)) AS INT) AS pos, {KMERS.format(k=12)} AS site FROM (SELECT doc_id, {DNA} AS s FROM documents))
SELECT doc_id, pos, site, CAST(hamming(substring(site, 1, 10), '{GUIDE}') AS INT) AS mismatches,
  CASE hamming(substring(site, 1, 10), '{GUIDE}') WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' ELSE 'low' END AS risk
FROM k WHERE site LIKE '%GG' AND hamming(substring(site, 1, 10), '{GUIDE}') <= 2""")
def seed_hamming_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = sequence.seed_scan(dna(spark, sf, "documents"), "doc_id", "s", GUIDE, "GG", 2)
    return found.withColumn("risk", F.when(F.col("mismatches") == 0, "high").when(F.col("mismatches") == 1, "moderate").otherwise("low"))

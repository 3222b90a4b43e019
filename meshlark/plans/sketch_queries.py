"""Queries of sketches, recall and the packed point form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.operators import similarity, sketches
from meshlark.plans.registry import query
from meshlark.plans.similarity_queries import EMB, PLANES, _bucket_sql
from meshlark.session import table
from meshlark.sources import packed


def _slot_sql(key: str, width: int) -> list[str]:
    return [f"((({key} % {sketches.PRIME}) * {a % sketches.PRIME} + {b}) % {sketches.PRIME}) % {width}" for a, b in sketches.HASHES]


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT {r} AS r, {s} AS slot, count(*) AS n FROM lineitem GROUP BY 2" for r, s in enumerate(_slot_sql("l_partkey", 997))) + "), q AS (" + " UNION ALL ".join(f"SELECT p_partkey, {r} AS r, {s} AS slot FROM part" for r, s in enumerate(_slot_sql("p_partkey", 997))) + ") SELECT p_partkey, min(coalesce(n, 0)) AS estimate FROM q LEFT JOIN s USING (r, slot) GROUP BY 1")
def frequency_estimate(spark: SparkSession, sf: str) -> DataFrame:
    sketch = sketches.count_min(table(spark, sf, "lineitem"), "l_partkey", 997)
    return sketches.estimate(sketch, table(spark, sf, "part"), "p_partkey", 997)


BLOOM_WIDTH = 8192


@query("WITH s AS (" + " UNION ".join(f"SELECT DISTINCT {s} AS slot FROM orders WHERE o_totalprice > 300000" for s in _slot_sql("o_custkey", BLOOM_WIDTH)) + ") SELECT c_custkey, " + " AND ".join(f"{s} IN (SELECT slot FROM s)" for s in _slot_sql("c_custkey", BLOOM_WIDTH)) + " AS maybe FROM customer")
def bloom_membership(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").filter("o_totalprice > 300000")
    return sketches.contained(sketches.bloom(big, "o_custkey", BLOOM_WIDTH), table(spark, sf, "customer"), "c_custkey", BLOOM_WIDTH)


@query(f"""{EMB}, b AS (SELECT *, CAST({_bucket_sql(PLANES)} AS BIGINT) AS bucket FROM v), p AS (SELECT id AS q_id, e AS q, xor(bucket, f) AS bucket FROM b, (SELECT unnest([0, 1, 2, 4, 8, 16, 32])::BIGINT AS f) WHERE id % 100 = 0),
l AS (SELECT q_id, id FROM (SELECT q_id, b.id AS id, row_number() OVER (PARTITION BY q_id ORDER BY list_cosine_similarity(q, e) DESC, b.id) AS k FROM p JOIN b USING (bucket) WHERE q_id <> b.id) WHERE k <= 10),
x AS (SELECT q_id, id FROM (SELECT q.id AS q_id, v.id AS id, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.id) AS k FROM v q JOIN v ON q.id <> v.id WHERE q.id % 100 = 0) WHERE k <= 10)
SELECT x.q_id, count(l.id) / 10.0::DOUBLE AS recall FROM x LEFT JOIN l ON x.q_id = l.q_id AND x.id = l.id GROUP BY 1""")
def lsh_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The share of the exact ten nearest that the probed buckets hold."""
    base = table(spark, sf, "embeddings")
    queries = base.filter("vec_id % 100 = 0")
    found = similarity.search_lsh(base, queries, PLANES, 6, 10).select("q_id", "id", F.lit(1).alias("hit"))
    exact = similarity.search_exact(base, queries, 10).select("q_id", "id")
    return exact.join(found, ["q_id", "id"], "left").groupBy("q_id").agg((F.count("hit") / 10.0).alias("recall"))


@query("SELECT event_id, true AS within FROM events")
def point_cloud_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each point comes back from its user's packed cloud to within a cell of 16 bits an axis."""
    p = table(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), F.col("value").alias("x"), (F.unix_seconds(F.col("ts").cast("timestamp")) / 3600.0).alias("y"), F.length("event_type").cast("double").alias("z"))
    back = packed.unpack_clouds(packed.pack_clouds(p, "user_id", ("x", "y", "z")), "user_id").withColumnsRenamed({"x": "bx", "y": "by", "z": "bz"})
    span = p.groupBy("user_id").agg(*[(F.max(c) - F.min(c)).alias(f"s{c}") for c in "xyz"])
    near = F.lit(True)
    for c in "xyz":
        near = near & (F.abs(F.col(c) - F.col(f"b{c}")) <= F.col(f"s{c}") / 65535 + 1e-9)
    return p.join(back, ["user_id", "id"]).join(span, "user_id").select(F.col("id").alias("event_id"), near.alias("within"))

"""Queries over grids, boxes, hierarchies and packed words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.functions import cells
from meshlark.operators import spatial
from meshlark.plans.registry import query
from meshlark.session import table

BOX = {"l_quantity": (10.0, 30.0), "l_discount": (0.02, 0.06), "l_extendedprice": (1000.0, 40000.0)}
BOX_SQL = """
SELECT count(*) AS n, round(sum(l_extendedprice * l_discount), 2) AS total FROM lineitem
WHERE l_quantity BETWEEN 10 AND 30 AND l_discount BETWEEN 0.02 AND 0.06 AND l_extendedprice BETWEEN 1000 AND 40000
"""


@query(BOX_SQL)
def box_range_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    out = spatial.box_aggregate(table(spark, sf, "lineitem"), BOX, F.col("l_extendedprice") * F.col("l_discount"))
    return out.select("n", F.round("total", 2).alias("total"))


@query(BOX_SQL)
def box_range_aggregate_cells(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "lineitem")
    sizes, value = {"l_quantity": 4.0, "l_extendedprice": 2048.0}, F.col("l_extendedprice") * F.col("l_discount")
    inside = points.filter(F.col("l_discount").between(*BOX["l_discount"]))
    cube = spatial.cell_cube(inside, sizes, value)
    return spatial.box_aggregate_cells(inside, cube, sizes, {k: BOX[k] for k in sizes}, value).select("n", F.round("total", 2).alias("total"))


@query("""
SELECT CAST(floor(l_quantity / 5.0) AS BIGINT) AS cx, CAST(floor(l_extendedprice / 5000.0) AS BIGINT) AS cy, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def grid_cell_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(cells.cell(F.col("l_quantity"), 5).alias("cx"), cells.cell(F.col("l_extendedprice"), 5000).alias("cy")).agg(F.count("*").alias("n"))


@query("""
SELECT CAST(floor(l_quantity / 5.0) AS BIGINT) AS cx, CAST(floor(l_extendedprice / 5000.0) AS BIGINT) AS cy,
  round(avg(l_quantity), 4) AS mx, round(avg(l_extendedprice), 4) AS my, round(sum(l_tax), 4) AS w
FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 25""")
def cell_centroids(spark: SparkSession, sf: str) -> DataFrame:
    keys = [cells.cell(F.col("l_quantity"), 5).alias("cx"), cells.cell(F.col("l_extendedprice"), 5000).alias("cy")]
    out = table(spark, sf, "lineitem").groupBy(*keys).agg(F.avg("l_quantity").alias("mx"), F.avg("l_extendedprice").alias("my"), F.sum("l_tax").alias("w"), F.count("*").alias("n"))
    return out.filter("n >= 25").select("cx", "cy", F.round("mx", 4).alias("mx"), F.round("my", 4).alias("my"), F.round("w", 4).alias("w"))


def _morton_sql(x: str, y: str, bits: int) -> str:
    return " | ".join(f"((({c} >> {b}) & 1) << {2 * b + d})" for b in range(bits) for d, c in enumerate((x, y)))


@query(f"""
WITH c AS (
  SELECT o_totalprice AS v, greatest(0, least(255, CAST(floor(o_totalprice / 600000.0 * 256) AS BIGINT))) AS ix,
    greatest(0, least(255, CAST(floor((datediff('day', DATE '1992-01-01', o_orderdate)) / 2560.0 * 256) AS BIGINT))) AS iy FROM orders
), m AS (SELECT v, {_morton_sql("ix", "iy", 8)} AS code FROM c)
SELECT depth, code >> (2 * (8 - depth)) AS prefix, count(*) AS n, round(sum(v), 2) AS total, round(min(v), 2) AS low
FROM m, (SELECT unnest(range(0, 9))::INT AS depth) GROUP BY 1, 2""")
def morton_hierarchy_rollup(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("day", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double"))
    code = cells.morton([cells.unit_cell(F.col("o_totalprice"), 0, 600000, 8), cells.unit_cell(F.col("day"), 0, 2560, 8)], 8)
    out = spatial.hierarchy(orders.select("o_totalprice", code.alias("code")), F.col("code"), 8, 2, [F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.min("o_totalprice").alias("low")])
    return out.select("depth", "prefix", "n", F.round("total", 2).alias("total"), F.round("low", 2).alias("low"))


@query("""
WITH p AS (SELECT c_custkey AS id, c_acctbal / 10.0 AS x, c_nationkey * 2.0 AS y FROM customer)
SELECT a.id AS l_id, b.id AS r_id, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance
FROM p a JOIN p b ON a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2.5 * 2.5""")
def epsilon_join_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10.0).alias("x"), (F.col("c_nationkey") * 2.0).alias("y"))
    return spatial.range_join(p, p, ["x", "y"], 2.5, keep=F.col("l_id") < F.col("r_id")).select("l_id", "r_id", F.round("distance", 6).alias("distance"))


@query("""
WITH a AS (SELECT s_suppkey AS id, s_acctbal / 10.0 AS x, s_nationkey * 2.0 AS y FROM supplier),
b AS (SELECT c_custkey AS id, c_acctbal / 10.0 AS x, c_nationkey * 2.0 AS y FROM customer)
SELECT a.id AS l_id, count(*) AS n, round(sum(exp(-sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2))), 6) AS weight
FROM a JOIN b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 16.0 GROUP BY 1""")
def range_join_two_sets(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 10.0).alias("x"), (F.col("s_nationkey") * 2.0).alias("y"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10.0).alias("x"), (F.col("c_nationkey") * 2.0).alias("y"))
    out = spatial.range_join(a, b, ["x", "y"], 4.0, strict=True).groupBy("l_id").agg(F.count("*").alias("n"), F.sum(F.exp(-F.col("distance"))).alias("weight"))
    return out.select("l_id", "n", F.round("weight", 6).alias("weight"))


@query("""
WITH p AS (SELECT c_custkey AS id, c_acctbal / 10.0 AS x, c_nationkey * 2.0 AS y FROM customer),
d AS (SELECT a.id AS l_id, b.id AS r_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM p a JOIN p b ON a.id <> b.id)
SELECT l_id, r_id, CAST(rank AS INT) AS rank, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY distance, r_id) AS rank FROM d) WHERE rank <= 4""")
def knn_grid(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10.0).alias("x"), (F.col("c_nationkey") * 2.0).alias("y"))
    return spatial.knn_rings(p, p, ["x", "y"], 4, 8.0).select("l_id", "r_id", "rank", F.round("distance", 6).alias("distance"))


@query("""
SELECT l_orderkey, l_linenumber, ((CAST(l_quantity AS BIGINT) & 63) | ((CAST(round(l_discount * 100) AS BIGINT) & 15) << 6)
  | ((CAST(round(l_tax * 100) AS BIGINT) & 15) << 10) | ((l_suppkey & 1048575) << 14)) AS word,
  CAST(l_quantity AS BIGINT) & 63 AS q, l_suppkey & 1048575 AS s FROM lineitem""")
def bit_pack_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    fields = [(F.col("l_quantity"), 6), (F.round(F.col("l_discount") * 100), 4), (F.round(F.col("l_tax") * 100), 4), (F.col("l_suppkey"), 20)]
    out = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cells.pack(fields).alias("word"))
    return out.withColumn("q", cells.unpack(F.col("word"), 0, 6)).withColumn("s", cells.unpack(F.col("word"), 14, 20))


@query("""
SELECT CAST(floor(l_extendedprice / 20000.0) AS BIGINT) AS tile, bit_or(CAST(1 AS BIGINT) << CAST(l_quantity AS INT)) AS board,
  CAST(bit_count(bit_or(CAST(1 AS BIGINT) << CAST(l_quantity AS INT))) AS INT) AS occupied FROM lineitem GROUP BY 1""")
def occupancy_bitboard(spark: SparkSession, sf: str) -> DataFrame:
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("l_quantity").cast("int"))
    out = table(spark, sf, "lineitem").groupBy(cells.cell(F.col("l_extendedprice"), 20000).alias("tile")).agg(F.bit_or(bit).alias("board"))
    return out.withColumn("occupied", F.bit_count("board"))


@query(f"""
WITH c AS (SELECT o_orderkey, greatest(0, least(255, CAST(floor(o_totalprice / 600000.0 * 256) AS BIGINT))) AS ix, o_custkey & 255 AS iy FROM orders),
m AS (SELECT o_orderkey, ix, iy, {_morton_sql("ix", "iy", 8)} AS code FROM c)
SELECT o_orderkey, code, ix AS back_x, iy AS back_y, CAST(lag(code, 1, 0) OVER (ORDER BY code, o_orderkey) AS BIGINT) AS previous,
  code - lag(code, 1, 0) OVER (ORDER BY code, o_orderkey) AS delta FROM m""")
def morton_delta_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Deltas along a Morton order: each range of the order needs only the last code of the range before it."""
    from meshlark.operators.ordered import ordered_lag

    orders = table(spark, sf, "orders")
    x, y = cells.unit_cell(F.col("o_totalprice"), 0, 600000, 8), F.col("o_custkey").bitwiseAND(255)
    coded = orders.select("o_orderkey", cells.morton([x, y], 8).alias("code"))
    coded = coded.withColumn("back_x", cells.unmorton(F.col("code"), 0, 2, 8)).withColumn("back_y", cells.unmorton(F.col("code"), 1, 2, 8))
    return ordered_lag(coded, ["code", "o_orderkey"], "code", "previous", 0).withColumn("delta", F.col("code") - F.col("previous"))


@query("""
WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
SELECT c_custkey, round(least(1.0, greatest(0.0, (c_acctbal - lo) / (hi - lo))), 8) AS u FROM customer, b""")
def affine_normalise(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    low, high = customer.agg(F.min("c_acctbal"), F.max("c_acctbal")).first() or (0.0, 1.0)
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("c_acctbal") - F.lit(low)) / F.lit(high - low)))
    return customer.select("c_custkey", F.round(u, 8).alias("u"))

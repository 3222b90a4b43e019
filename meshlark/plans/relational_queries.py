"""Ordinary relational queries over the star schema and the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.plans.registry import query
from meshlark.session import table


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(price), 2).alias("sum_disc"),
        F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY 1""")
def local_revenue(spark: SparkSession, sf: str) -> DataFrame:
    region = table(spark, sf, "region")
    first = region.agg(F.min("r_name")).first()[0]
    nation = table(spark, sf, "nation").join(region.filter(F.col("r_name") == first), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    line = table(spark, sf, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_extendedprice", "l_discount", "n_name")
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'P' GROUP BY 1")
def left_join_counts(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) GROUP BY 1")
def anti_join_segments(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").filter("o_totalprice > 200000").select("o_custkey")
    return table(spark, sf, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(nc, 0) AS customers, coalesce(ns, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS nc FROM customer WHERE c_acctbal > 8000 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS ns FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def full_join_nations(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").filter("c_acctbal > 8000").groupBy("c_nationkey").agg(F.count("*").alias("nc"))
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("ns"))
    return c.join(s, c.c_nationkey == s.s_nationkey, "full").select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), F.coalesce("nc", F.lit(0)).alias("customers"), F.coalesce("ns", F.lit(0)).alias("suppliers"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(grouping(o_orderstatus) AS INT) AS g1, CAST(grouping(o_orderpriority) AS INT) AS g2 FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping("o_orderstatus").cast("int").alias("g1"), F.grouping("o_orderpriority").cast("int").alias("g2"))


@query("SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_regions(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 25) AS suppliers FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf, "lineitem").groupingSets([[flag], [status], []], flag, status).agg(F.count("*").alias("n"), F.expr("count(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 25)").alias("suppliers"))


@query("SELECT o_custkey, o_orderkey, CAST(rank AS INT) AS rank, round(running, 2) AS running FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM orders) WHERE rank <= 3")
def top_orders_per_customer(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    out = table(spark, sf, "orders").withColumn("rank", F.row_number().over(w)).withColumn("running", F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.filter("rank <= 3").select("o_custkey", "o_orderkey", "rank", F.round("running", 2).alias("running"))


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    return a.intersect(table(spark, sf, "supplier").select("s_nationkey")).subtract(table(spark, sf, "nation").filter("n_regionkey = 1").select("n_nationkey"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS INT)), 6) AS k FROM events GROUP BY 1, 2")
def events_by_day(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg(k), 6).alias("k"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 2) AS r, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 2) AS a, round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 2) AS n FROM lineitem GROUP BY 1")
def pivot_flags(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["R", "A", "N"]).agg(F.round(F.sum("l_quantity"), 2))
    return out.withColumnsRenamed({"R": "r", "A": "a", "N": "n"})


@query("SELECT c_custkey, CASE WHEN activity = 0 THEN 'none' WHEN activity < 2.5 THEN 'low' WHEN activity < 6 THEN 'normal' ELSE 'high' END AS phenotype, activity FROM (SELECT c_custkey, coalesce(sum(CASE WHEN o_orderkey IS NULL THEN 0.0::DOUBLE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE WHEN o_orderpriority = '2-HIGH' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END), 0) AS activity FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)")
def star_activity_phenotype(spark: SparkSession, sf: str) -> DataFrame:
    score = spark.createDataFrame([("1-URGENT", 1.0), ("2-HIGH", 0.5)], "o_orderpriority string, score double")
    own = table(spark, sf, "orders").join(F.broadcast(score), "o_orderpriority", "left").groupBy("o_custkey").agg(F.sum(F.coalesce("score", F.lit(0.25))).alias("activity"))  # two fixed rows
    out = table(spark, sf, "customer").join(own, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("activity", F.lit(0.0)).alias("activity"))
    a = F.col("activity")
    return out.select("c_custkey", F.when(a == 0, "none").when(a < 2.5, "low").when(a < 6, "normal").otherwise("high").alias("phenotype"), "activity")

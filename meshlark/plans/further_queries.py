"""Queries of block transforms, kernels by name, registered functions, sketches of sets, latest windows and light."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.functions import maths
from meshlark.operators import fields, series, sketches, spatial
from meshlark.plans.registry import query
from meshlark.plans.solver_queries import D2, P, _field
from meshlark.session import table

DCT = """WITH b AS (SELECT vec_id, k // 8 AS i, k % 8 AS j, 100.0 * CAST(embedding[k + 1] AS DOUBLE) AS x FROM embeddings, range(64) t(k)),
f AS (SELECT u, v, sqrt(CASE WHEN u = 0 THEN 1 ELSE 2 END / 8.0) * sqrt(CASE WHEN v = 0 THEN 1 ELSE 2 END / 8.0) AS s FROM range(8) a(u), range(8) c(v)),
c AS (SELECT vec_id, u, v, sum(x * s * cos((2 * i + 1) * u * pi() / 16) * cos((2 * j + 1) * v * pi() / 16)) AS c FROM b, f GROUP BY 1, 2, 3),
z AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY u + v, CASE WHEN (u + v) % 2 = 1 THEN u ELSE -u END) - 1 AS place, CAST(round(c / (8 + 2 * (u + v))) AS INT) AS level FROM c)
SELECT vec_id, CAST(place AS INT) AS place, level FROM z WHERE level <> 0"""


@query(DCT)
def dct_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as 8 x 8 blocks: cosine transform, quantised, in zig-zag order; levels other than zero."""
    block = F.transform(F.slice("embedding", 1, 64), lambda x: 100.0 * x.cast("double"))
    levels = maths.quantised(maths.dct_zigzag(block), lambda u, v: 8.0 + 2 * (u + v))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(levels).alias("place", "level")).filter("level != 0")


@query(f"""WITH {P}, d AS (SELECT a.id, sqrt({D2}) AS d, b.u FROM p a JOIN p b ON a.id <> b.id AND {D2} <= 36.0)
SELECT id, round(sum(exp(-d * d / 18.0) * u), 6) AS rbf, round(sum(CASE WHEN d < 6 THEN (1 - d / 6.0) ** 4 * (4 * d / 6.0 + 1) ELSE 0 END * u), 6) AS wendland, round(sum(u / (1 + d * d / 36.0)), 6) AS rational FROM d GROUP BY 1""")
def kernel_choices(spark: SparkSession, sf: str) -> DataFrame:
    p = _field(spark, sf)
    near = spatial.class_pairs(p, ["x", "y"], 6.0)
    sums = near.groupBy("l_id").agg(*[F.round(F.sum(F.col("m") * maths.kernel(name, F.col("distance"), 6.0) * F.col("r_u")), 6).alias(name) for name in maths.KERNELS])
    return spatial.of_members(sums, p)


ERF_POLY = "((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t"


@query(f"""WITH x AS (SELECT event_id, value / 25.0 - 2 AS x FROM events), t AS (SELECT *, 1 / (1 + 0.3275911 * abs(x)) AS t FROM x)
SELECT event_id, round(sign(x) * (1 - {ERF_POLY} * exp(-x * x)), 7) AS erf, round(1 - sign(x) * (1 - {ERF_POLY} * exp(-x * x)), 7) AS erfc, round(x / (1 + exp(-x)), 7) AS silu FROM t""")
def special_functions(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("value") / 25.0 - 2
    return table(spark, sf, "events").select("event_id", F.round(maths.erf(x), 7).alias("erf"), F.round(maths.erfc(x), 7).alias("erfc"), F.round(maths.silu(x), 7).alias("silu"))


@query("""SELECT CASE WHEN value < 25 THEN 'low' WHEN value < 75 THEN 'middle' ELSE 'high' END AS band, count(*) AS n, round(sum((value / 50 - 1) / (1 + exp(-(value / 50 - 1)))), 5) AS silu,
round(sum(CASE WHEN value < 60 THEN (1 - value / 60) ** 4 * (4 * value / 60 + 1) ELSE 0 END), 5) AS wendland FROM events GROUP BY 1""")
def registered_functions(spark: SparkSession, sf: str) -> DataFrame:
    """A statement that uses the session's registered functions."""
    maths.register(spark)
    table(spark, sf, "events").createOrReplaceTempView("_registered_events")
    return spark.sql("SELECT ml_band(value, 25, 75) AS band, count(*) AS n, round(sum(ml_silu(value / 50 - 1)), 5) AS silu, round(sum(ml_wendland(value, 60)), 5) AS wendland FROM _registered_events GROUP BY 1")


@query("SELECT c_mktsegment, round(var_pop(c_acctbal / 1000) + var_pop(c_nationkey), 6) AS dispersion, count(*) AS n FROM customer GROUP BY 1")
def opinion_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.groupBy("c_mktsegment").agg(F.round(F.var_pop(F.col("c_acctbal") / 1000) + F.var_pop("c_nationkey"), 6).alias("dispersion"), F.count("*").alias("n"))


@query("""WITH m AS (SELECT user_id, max(epoch(ts)) AS last FROM events GROUP BY 1)
SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, max(event_id) AS newest FROM events JOIN m USING (user_id) WHERE epoch(ts) > last - 86400 GROUP BY 1""")
def latest_window(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's last day before the latest event."""
    e = table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return series.latest_window(e, "user_id", "t", 86400.0).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("event_id").alias("newest"))


@query("""WITH s AS (SELECT DISTINCT s_nationkey AS g, CAST('0x' || substr(md5(CAST(l_partkey AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
k AS (SELECT g, h FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY h) AS r FROM s) WHERE r <= 64),
u AS (SELECT a.g AS a, b.g AS b, h, count(*) AS held FROM (SELECT DISTINCT g FROM k) a JOIN (SELECT DISTINCT g FROM k) b ON a.g < b.g JOIN k ON k.g = a.g OR k.g = b.g GROUP BY 1, 2, 3),
l AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY h) AS r FROM u)
SELECT a, b, round(count(*) FILTER (WHERE held = 2) / count(*), 6) AS jaccard FROM l WHERE r <= 64 GROUP BY 1, 2""")
def sketch_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Estimates from the 64 least hashes of each nation's set of parts."""
    parts = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    hashed = F.conv(F.substring(F.md5(F.col("l_partkey").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    return sketches.bottom_jaccard(parts.select(F.col("s_nationkey").alias("g"), hashed.alias("h")), "g", "h", 64).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


SURFEL = "SELECT s_suppkey AS id, s_nationkey AS cid, s_acctbal / 1000 AS x, s_nationkey * 5e-1 AS y, s_suppkey % 7 * 4e-1 AS z, cos(s_suppkey % 11) AS nx, sin(s_suppkey % 11) AS ny, 0e0 AS nz, 1e0 + s_suppkey % 3 AS flux FROM supplier"


@query(f"""WITH s AS ({SURFEL}), c AS (SELECT cid, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(nx) AS nx, avg(ny) AS ny, avg(nz) AS nz, 0.1 * count(*) AS area, avg(flux) AS flux FROM s GROUP BY 1),
d AS (SELECT s.id, c.area, c.flux, c.x - s.x AS dx, c.y - s.y AS dy, c.z - s.z AS dz, s.nx, s.ny, s.nz, c.nx AS mx, c.ny AS my, c.nz AS mz FROM s, c), e AS (SELECT *, dx * dx + dy * dy + dz * dz AS d2 FROM d)
SELECT id, round(sum(greatest((nx * dx + ny * dy + nz * dz) / sqrt(d2 + 1e-12), 0) * greatest(-(mx * dx + my * dy + mz * dz) / sqrt(d2 + 1e-12), 0) * area / (pi() * d2 + area) * flux * 0.6), 6) AS light FROM e GROUP BY 1""")
def radiosity_bounce(spark: SparkSession, sf: str) -> DataFrame:
    """One bounce from all clusters of surfels, a cluster for each nation."""
    table(spark, sf, "supplier").createOrReplaceTempView("_surfel_supplier")
    s = spark.sql(SURFEL.replace("FROM supplier", "FROM _surfel_supplier"))
    means = [F.avg(c).alias(c) for c in ("x", "y", "z", "nx", "ny", "nz", "flux")]
    return fields.radiosity_bounce(s.drop("cid"), s.groupBy("cid").agg(*means, (0.1 * F.count("*")).alias("area")), 0.6).select("id", F.round("light", 6).alias("light"))


@query(f"""WITH {P}, r AS (SELECT id, u AS r, 1.0 + id % 4 AS d, CAST(floor(x / 50.0) AS BIGINT) AS c FROM p), s AS (SELECT c, sum(r) / sum(d) AS z FROM r GROUP BY 1)
SELECT id, round(0.7 * r / d + 0.3 * z, 8) AS z FROM r JOIN s USING (c)""")
def two_level_correction(spark: SparkSession, sf: str) -> DataFrame:
    rows = _field(spark, sf).select("id", F.col("u").alias("r"), (1.0 + F.col("id") % 4).alias("d"), "x")
    return fields.two_level(rows, F.floor(F.col("x") / 50.0)).select("id", F.round("z", 8).alias("z"))

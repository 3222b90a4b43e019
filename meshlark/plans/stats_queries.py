"""Queries of statistics and ordered sequences."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.operators import series, stats
from meshlark.plans.registry import query
from meshlark.session import table

INSTRUMENTS_SQL = """WITH i AS (SELECT l_suppkey AS g, l_orderkey AS k, l_linenumber AS ln, l_quantity / 10.0 AS bx, 0.1 AS sx, l_extendedprice / 10000.0 AS "by", 0.5 + l_tax AS sy, l_quantity AS f FROM lineitem WHERE l_quantity >= 10)"""


def _instruments(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    out = line.select(F.col("l_suppkey").alias("g"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), (F.col("l_quantity") / 10.0).alias("bx"), F.lit(0.1).alias("sx"), (F.col("l_extendedprice") / 10000.0).alias("by"), (0.5 + F.col("l_tax")).alias("sy"), F.col("l_quantity").alias("f"))
    return stats.instruments(out)


@query(INSTRUMENTS_SQL + """, s AS (SELECT g, count(*) AS n, sum(1 / (sy * sy)) AS w, sum(bx / (sy * sy)) AS wx, sum("by" / (sy * sy)) AS wy, sum(bx * "by" / (sy * sy)) AS wxy,
  sum(bx * bx / (sy * sy)) AS wxx, sum("by" * "by" / (sy * sy)) AS wyy FROM i GROUP BY 1),
e AS (SELECT *, (wxy / w - wx * wy / (w * w)) / (wxx / w - (wx / w) ** 2) AS egger FROM s)
SELECT g AS l_suppkey, n, round(wxy / wxx, 6) AS ivw, round(sqrt(1 / wxx), 6) AS ivw_se, round(greatest(0.0, wyy - wxy / wxx * wxy), 4) AS q, round(egger, 6) AS egger, round(wy / w - egger * wx / w, 6) AS egger_intercept FROM e WHERE n >= 2""")
def ivw_egger_regression(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.causal_regressions(_instruments(spark, sf), "g")
    return out.select(F.col("g").alias("l_suppkey"), "n", F.round("ivw", 6).alias("ivw"), F.round("ivw_se", 6).alias("ivw_se"), F.round("q", 4).alias("q"), F.round("egger", 6).alias("egger"), F.round("egger_intercept", 6).alias("egger_intercept"))


@query(INSTRUMENTS_SQL + """, r AS (SELECT g, "by" / bx AS ratio, bx * bx / (sy * sy) AS w, k, ln FROM i),
c AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY ratio, k, ln ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY g) AS total FROM r)
SELECT g AS l_suppkey, round(min(ratio), 8) AS median FROM c WHERE run >= 0.5 * total GROUP BY 1""")
def weighted_median(spark: SparkSession, sf: str) -> DataFrame:
    rows = _instruments(spark, sf).select("g", "k", "ln", (F.col("by") / F.col("bx")).alias("ratio"), (F.col("bx") * F.col("bx") / (F.col("sy") * F.col("sy"))).alias("w"))
    return stats.weighted_median(rows, "g", "ratio", "w", ["k", "ln"]).select(F.col("g").alias("l_suppkey"), F.round("median", 8).alias("median"))


PAIR_SQL = "WITH s AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS guess FROM lineitem GROUP BY 1), p AS (SELECT o_orderkey AS k, o_totalprice AS truth, guess FROM orders JOIN s ON o_orderkey = s.k)"


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    guess = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("guess"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("truth")).join(guess, "k")


@query(PAIR_SQL + " SELECT count(*) AS n, round(corr(truth, guess), 6) AS r, round(sqrt(avg((guess - truth) ** 2)), 2) AS rmse, round(avg(abs(guess - truth)), 2) AS mae, round(1 - sum((guess - truth) ** 2) / (var_pop(truth) * count(*)), 6) AS r2 FROM p")
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.regression_metrics(_truth(spark, sf), "truth", "guess")
    return out.select("n", F.round("r", 6).alias("r"), F.round("rmse", 2).alias("rmse"), F.round("mae", 2).alias("mae"), F.round("r2", 6).alias("r2"))


@query(PAIR_SQL + ", r AS (SELECT CAST(row_number() OVER (ORDER BY truth, k) AS DOUBLE) AS r1, CAST(row_number() OVER (ORDER BY round(guess, 4), k) AS DOUBLE) AS r2 FROM p) SELECT round(corr(r1, r2), 6) AS rho FROM r")
def ordinal_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return stats.ordinal_correlation(_truth(spark, sf).withColumn("guess", F.round("guess", 4)), "k", "truth", "guess").select(F.round("rho", 6).alias("rho"))


@query("""
WITH d AS (SELECT n_chars AS s, toxic AS t FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM d),
c AS (SELECT sum(CASE WHEN t = 1 THEN k END) AS u, sum(t) AS p, sum(1 - t) AS n, sum(CASE WHEN s >= 2000 THEN t ELSE 0 END) AS tp, sum(CASE WHEN s >= 2000 THEN 1 - t ELSE 0 END) AS fp FROM r)
SELECT round((u - p * (p + 1) / 2.0) / (p * n), 8) AS auc, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(p - tp AS BIGINT) AS fn, CAST(n - fp AS BIGINT) AS tn, round(tp / p, 8) AS sensitivity, round((n - fp) / n, 8) AS specificity,
  round(2.0 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p), 8) AS f1 FROM c""")
def classification_metrics_auc(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    out = stats.classification_metrics(docs, F.col("toxic") == 1, "n_chars", 2000)
    return out.select(F.round("auc", 8).alias("auc"), "tp", "fp", "fn", "tn", *[F.round(c, 8).alias(c) for c in ("sensitivity", "specificity", "f1")])


@query("SELECT ((o_custkey % 1000003) * 7919 + 104729) % 1000003 % 5 AS fold, count(DISTINCT o_custkey) AS customers, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def group_folds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(stats.group_fold(F.col("o_custkey"), 5).alias("fold")).agg(F.countDistinct("o_custkey").alias("customers"), F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
WITH e AS (SELECT event_type AS c, CAST(json_extract_string(props, '$.k') AS INT) AS k, value FROM events),
b AS (SELECT k, avg(value) AS m0, stddev_pop(value) AS s0 FROM e WHERE c = 'view' GROUP BY 1), o AS (SELECT c, k, avg(value) AS m FROM e WHERE c <> 'view' GROUP BY 1, 2)
SELECT c AS event_type, k, round((m - m0) / (s0 + 1e-3), 6) AS z FROM o JOIN b USING (k)""")
def perturb_zscores(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), "value")
    return stats.z_scores(e, "k", "event_type", "value", "view").select("event_type", "k", F.round("z", 6).alias("z"))


MULTIPLIERS = {"x": (7919, 104729), "y": (15485863, 32452843), "z": (49979687, 67867967)}


@query("WITH s AS (SELECT i, " + ", ".join(f"((i * {a} + {a % 977}) % 1000003) / 1000003.0 AS a_{n}, ((i * {b} + {b % 977}) % 1000003) / 1000003.0 AS b_{n}" for n, (a, b) in MULTIPLIERS.items()) + """ FROM (SELECT unnest(range(0, 20000)) AS i)),
f AS (SELECT a_x + 2 * a_y * a_y + a_x * a_z AS fa, b_x + 2 * b_y * b_y + b_x * b_z AS fb, b_x + 2 * a_y * a_y + b_x * a_z AS f_x, a_x + 2 * b_y * b_y + a_x * a_z AS f_y, a_x + 2 * a_y * a_y + a_x * b_z AS f_z FROM s)
""" + " UNION ALL ".join(f"SELECT '{n}' AS name, round(avg(fb * (f_{n} - fa)) / var_pop(fa), 6) AS first, round(0.5 * avg((fa - f_{n}) ** 2) / var_pop(fa), 6) AS total FROM f" for n in MULTIPLIERS))
def sobol_indices(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    at = lambda m: ((i * m + m % 977) % 1000003) / 1000003.0
    samples = spark.range(20000).select(*[c for n, (a, b) in MULTIPLIERS.items() for c in (at(a).alias(f"a_{n}"), at(b).alias(f"b_{n}"))])
    out = stats.sobol(samples, lambda x, y, z: x + 2 * y * y + x * z, list(MULTIPLIERS))
    return out.select("name", F.round("first", 6).alias("first"), F.round("total", 6).alias("total"))


WAVES = [(0.7, 0.1), (1.3, 1.1), (2.1, 2.3), (0.3, 0.7)]


def _wave_sql(x: str) -> list[str]:
    return [f"cos({x} * {w} + {b}) * sqrt(0.5)" for w, b in WAVES]


@query("SELECT round(" + " + ".join(f"covar_pop({a}, {b}) ** 2" for a in _wave_sql("(l_quantity / 10.0)") for b in _wave_sql("(l_extendedprice / 10000.0)")) + ", 8) AS hsic FROM lineitem")
def hsic_rff(spark: SparkSession, sf: str) -> DataFrame:
    return stats.hsic(table(spark, sf, "lineitem"), F.col("l_quantity") / 10.0, F.col("l_extendedprice") / 10000.0, WAVES).select(F.round("hsic", 8).alias("hsic"))


@query("SELECT l_returnflag, round(CASE WHEN avg((a - b) ** 2) < 1e-10 THEN 100 ELSE 10 * log10(255.0 * 255.0 / avg((a - b) ** 2)) END, 6) AS psnr, round((2 * avg(a) * avg(b) + 6.5025) * (2 * covar_pop(a, b) + 58.5225) / ((avg(a) ** 2 + avg(b) ** 2 + 6.5025) * (var_pop(a) + var_pop(b) + 58.5225)), 6) AS ssim FROM (SELECT l_returnflag, l_quantity AS a, l_extendedprice / 1000.0 AS b FROM lineitem) GROUP BY 1")
def psnr_ssim(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000.0).alias("b"))
    mse, ma, mb = F.avg(F.pow(F.col("a") - F.col("b"), F.lit(2.0))), F.avg("a"), F.avg("b")
    psnr = F.when(mse < 1e-10, 100.0).otherwise(10 * F.log10(255.0 * 255.0 / mse))
    ssim = (2 * ma * mb + 6.5025) * (2 * F.covar_pop("a", "b") + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (F.var_pop("a") + F.var_pop("b") + 58.5225))
    return x.groupBy("l_returnflag").agg(F.round(psnr, 6).alias("psnr"), F.round(ssim, 6).alias("ssim"))


# ---------------------------------------------------------------- ordered sequences


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))


@query("SELECT * FROM (SELECT event_id, user_id, value AS x0, lag(value, 2) OVER w AS x1, lag(value, 4) OVER w AS x2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE x2 IS NOT NULL")
def delay_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return series.delay_embedding(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 2, 3).select("event_id", "user_id", "x0", "x1", "x2")


EMBEDDED = "e AS (SELECT * FROM (SELECT event_id, value AS x, lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM events) WHERE y IS NOT NULL)"


def _density(spark: SparkSession, sf: str) -> DataFrame:
    from meshlark.operators.spatial import range_join

    e = series.delay_embedding(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 1, 2).select("event_id", F.col("x0").alias("x"), F.col("x1").alias("y"))
    near = range_join(e, e, ["x", "y"], 1.5, keep=F.col("l_event_id") != F.col("r_event_id")).groupBy(F.col("l_event_id").alias("event_id")).agg(F.count("*").alias("n"))
    return e.join(near, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {EMBEDDED} SELECT a.event_id, count(b.event_id) AS n FROM e a LEFT JOIN e b ON a.event_id <> b.event_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2.25 GROUP BY 1")
def recurrence_density(spark: SparkSession, sf: str) -> DataFrame:
    return _density(spark, sf)


@query(f"WITH {EMBEDDED}, d AS (SELECT a.event_id, count(b.event_id) AS n FROM e a LEFT JOIN e b ON a.event_id <> b.event_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2.25 GROUP BY 1) SELECT event_id, n FROM d WHERE n <= (SELECT quantile_cont(n, 0.05) FROM d)")
def attractor_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    d = _density(spark, sf)
    cut = d.agg(F.percentile("n", 0.05)).first()[0]
    return d.filter(F.col("n") <= F.lit(cut))


@query("SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events")
def delta_encode(spark: SparkSession, sf: str) -> DataFrame:
    return series.first_difference(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "delta")


@query("""
WITH s AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS t0 FROM events WHERE event_type = 'purchase'), x AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS t, value FROM events WHERE event_type = 'view')
SELECT CAST(floor((t - t0) / 300.0) AS BIGINT) AS bin, count(*) AS n, round(avg(value), 6) AS mean FROM s JOIN x ON t >= t0 - 1800 AND t < t0 + 3600 GROUP BY 1""")
def epoch_average(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    out = series.epoch_average(e.filter("event_type = 'purchase'").select("t"), e.filter("event_type = 'view'").select("t", "value"), 1800, 3600, 300)
    return out.select("bin", "n", F.round("mean", 6).alias("mean"))


@query("""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT p.event_id, p.user_id, v.value AS last_view FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_last_view(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    views = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return series.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "value", "last_view").select("event_id", "user_id", "last_view")


@query("""
WITH p AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2),
a AS (SELECT p.*, v.t AS ta, v.value AS va FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t), b AS (SELECT p.event_id, v.t AS tb, v.value AS vb FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t <= v.t)
SELECT a.event_id, CASE WHEN ta IS NULL OR (tb IS NOT NULL AND tb - t < t - ta) THEN vb ELSE va END AS nearest FROM a JOIN b USING (event_id)""")
def asof_nearest_view(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    views = e.filter("event_type = 'view'").groupBy("user_id", "t").agg(F.max("value").alias("value"))
    return series.nearest(e.filter("event_type = 'purchase'").select("event_id", "user_id", "t"), views, "user_id", "t", "value", "nearest").select("event_id", "nearest")


_AD = 1.0 / (1.0 + 30.0 / (2.0 * math.pi))
_TAU = 2.0 * math.pi
ONE_EURO = f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, value * 100 AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT event_id, user_id, i, x AS h, 0.0::DOUBLE AS d FROM e WHERE i = 1
  UNION ALL
  SELECT event_id, user_id, i, a * x + (1 - a) * h AS h, d FROM (
    SELECT event_id, user_id, i, x, h, d, 1.0 / (1.0 + 30.0 / ({_TAU!r} * (0.2 + 0.15 * abs(d)))) AS a FROM (
      SELECT e.event_id, e.user_id, e.i, e.x, f.h, {_AD!r} * (e.x - f.h) * 30.0 + {1 - _AD!r} * f.d AS d FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)))"""


def _filtered(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", (F.col("value") * 100).alias("x"))
    return series.one_euro(e, "user_id", ["ts", "event_id"], "x", 30.0, 0.2, 0.15).select("event_id", "user_id", "h")


@query(ONE_EURO + " SELECT event_id, round(h, 4) AS h FROM f")
def one_euro_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf).select("event_id", F.round("h", 4).alias("h"))


@query(ONE_EURO + """ SELECT rung, count(*) AS n FROM (SELECT CASE WHEN h * 0.85 >= 15000 THEN 15000 WHEN h * 0.85 >= 8000 THEN 8000 WHEN h * 0.85 >= 5000 THEN 5000
  WHEN h * 0.85 >= 2500 THEN 2500 WHEN h * 0.85 >= 1200 THEN 1200 ELSE 500 END AS rung FROM f) GROUP BY 1""")
def bitrate_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf).groupBy(series.rung(F.col("h")).alias("rung")).agg(F.count("*").alias("n"))


SEGMENTS = """
WITH RECURSIVE e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS i FROM events),
s AS (SELECT user_id, i, t, t AS start FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.t, CASE WHEN e.t - s.start >= 86400 * 0.85 THEN e.t ELSE s.start END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)"""


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    times = _events(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return times.select("user_id", series.segments(F.col("ts"), 86400.0).alias("starts"), F.element_at("ts", -1).alias("last"))


@query(SEGMENTS + " SELECT user_id, start, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start) - 1 AS INT) AS segment FROM (SELECT DISTINCT user_id, start FROM s)")
def greedy_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf).select("user_id", F.posexplode("starts").alias("segment", "start"))


@query(SEGMENTS + """, g AS (SELECT user_id, start, row_number() OVER w - 1 AS i, coalesce(lead(start) OVER w, last) - start AS d FROM (SELECT user_id, start, max(t) AS last FROM s GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY start))
SELECT user_id, concat('#EXTM3U\n#EXT-X-VERSION:6\n#EXT-X-TARGETDURATION:', max(d), '\n', string_agg(concat('#EXTINF:', d, '.0000,\nu', user_id, '_', i, '.m4s'), '\n' ORDER BY i), '\n#EXT-X-ENDLIST') AS manifest FROM g GROUP BY 1""")
def hls_manifest(spark: SparkSession, sf: str) -> DataFrame:
    from meshlark.sources.manifests import hls

    out = _segments(spark, sf)
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array("last"))
    return out.select("user_id", hls(F.zip_with(ends, "starts", lambda e, s: e - s), F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("manifest"))


@query("""
WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), n AS (SELECT *, CASE WHEN t - lag(t) OVER w > 43200 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM n)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, max(t) - min(t) AS span FROM s GROUP BY 1, 2""")
def sessionise(spark: SparkSession, sf: str) -> DataFrame:
    return series.sessions(_events(spark, sf), "user_id", "t", 43200).groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"))


@query("""WITH RECURSIVE f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, CAST('0x' || substr(md5(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)), 1, 15) AS BIGINT) AS bits FROM events),
g AS (SELECT user_id, frame, 'IDR' AS kind, CAST(0 AS BIGINT) AS gop, CAST(0 AS BIGINT) AS since, bits FROM f WHERE frame = 0
UNION ALL SELECT user_id, frame, CASE WHEN cut THEN 'IDR' WHEN since % 3 <> 0 THEN 'B' ELSE 'P' END, gop + CAST(cut AS BIGINT), CASE WHEN cut THEN 0 ELSE since END, bits FROM (
  SELECT f.user_id, f.frame, g.gop, g.since + 1 AS since, f.bits, (bit_count(xor(f.bits, g.bits)) >= 18 AND g.since + 1 >= 4) OR g.since + 1 >= 30 AS cut FROM g JOIN f ON f.user_id = g.user_id AND f.frame = g.frame + 1))
SELECT user_id, frame, kind, gop, since FROM g""")
def gop_decisions(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.md5(F.floor("value").cast("bigint").cast("string").cast("binary"))
    frames = table(spark, sf, "events").withColumn("bits", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"))
    return series.gop_decisions(frames, "user_id", "event_id", "bits")


@query()
def tumbling_band_power(spark: SparkSession, sf: str) -> DataFrame:
    return series.band_power(table(spark, sf, "events"), "user_id", "event_id", "value", 1.0, 0.05, 0.15)


@query()
def dtw_distance(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    first = events.agg(F.min("user_id")).first()[0]
    return series.dtw_distances(events, "user_id", "event_id", "value", first)


@query("SELECT user_id, regr_slope(y, x) AS slope_, count(*) AS n FROM (SELECT user_id, value AS x, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM events) WHERE y IS NOT NULL GROUP BY 1".replace("regr_slope(y, x) AS slope_", "round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept"))
def koopman_one_step(spark: SparkSession, sf: str) -> DataFrame:
    """The best linear one-step map of each user's series."""
    from pyspark.sql import Window

    pairs = table(spark, sf, "events").withColumn("y", F.lead("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("y is not null")
    return pairs.groupBy("user_id").agg(F.round(F.regr_slope("y", "value"), 6).alias("slope"), F.round(F.regr_intercept("y", "value"), 6).alias("intercept"), F.count("*").alias("n"))

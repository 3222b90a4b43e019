"""Queries of interaction lists, roll-ups of moments, variant joins, message passing and dense solvers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.functions import cells, text
from meshlark.operators import dense, fields, similarity, spatial
from meshlark.plans.graph_queries import SOURCES, _charges
from meshlark.plans.registry import query
from meshlark.plans.similarity_queries import DNA, GUIDE, KMERS, dna
from meshlark.plans.solver_queries import D2, P, _field
from meshlark.plans.stats_queries import SEGMENTS, _segments
from meshlark.session import table


@query(f"WITH k AS (SELECT item_id, {KMERS.format(k=8)} AS kmer FROM (SELECT item_id, {DNA} AS s FROM benchmark)) SELECT item_id, kmer, CAST(hamming(kmer, '{GUIDE[:8]}') AS INT) AS mismatches, count(*) AS n FROM k WHERE hamming(kmer, '{GUIDE[:8]}') <= 1 GROUP BY 1, 2, 3")
def hamming_one_join(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds within one substitution, by an equi-join with the guide's 1 + 3 n variants."""
    guide = GUIDE[:8]
    variants = {guide} | {guide[:i] + b + guide[i + 1 :] for i in range(len(guide)) for b in "ACGT"}
    own = spark.createDataFrame([(v,) for v in sorted(variants)], "kmer string")
    found = dna(spark, sf, "benchmark").select("item_id", F.explode(text.kmers(F.col("s"), 8)).alias("kmer")).join(F.broadcast(own), "kmer")  # 25 variants
    return found.withColumn("mismatches", text.mismatches(F.col("kmer"), F.lit(guide))).groupBy("item_id", "kmer", "mismatches").agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT DISTINCT p_name AS word FROM part) SELECT a.word AS a, b.word AS b, CAST(CASE WHEN levenshtein(a.word, b.word) <= 3 THEN levenshtein(a.word, b.word) ELSE greatest(length(a.word), length(b.word)) END AS INT) AS distance FROM w a JOIN w b ON a.word < b.word AND substring(a.word, 1, 1) = substring(b.word, 1, 1)")
def banded_levenshtein(spark: SparkSession, sf: str) -> DataFrame:
    """Edit distance within a band of three; beyond it the longer length. Pairs share their first letter,
    as in the SQL; ``levenshtein_pairs`` finds all within three edits."""
    w = table(spark, sf, "part").select(F.col("p_name").alias("word")).distinct().withColumn("k", F.substring("word", 1, 1))
    pairs = w.withColumnRenamed("word", "a").join(w.withColumnRenamed("word", "b"), "k").filter("a < b")
    d = F.levenshtein("a", "b", 3)
    return pairs.select("a", "b", F.when(d == -1, F.greatest(F.length("a"), F.length("b"))).otherwise(d).alias("distance"))


@query("WITH w AS (SELECT DISTINCT p_name AS word FROM part) SELECT a.word AS a, b.word AS b, CAST(levenshtein(a.word, b.word) AS INT) AS distance FROM w a JOIN w b ON a.word < b.word AND levenshtein(a.word, b.word) <= 3")
def levenshtein_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs within three edits, whatever their first letters."""
    w = table(spark, sf, "part").select(F.col("p_name").alias("word")).distinct()
    return similarity.fuzzy_join(w, w, 3).filter("l_word < r_word").select(F.col("l_word").alias("a"), F.col("r_word").alias("b"), "distance")


@query(SOURCES + """, c AS (SELECT *, CAST(floor(x / 0.25) AS BIGINT) AS ix, CAST(floor(y / 0.25) AS BIGINT) AS iy FROM p)
SELECT ix, iy, count(*) AS n, round(sum(q), 9) AS q, round(sum(q * (x - (ix + 0.5) * 0.25)), 9) + 0.0 AS re_1, round(sum(q * (y - (iy + 0.5) * 0.25)), 9) + 0.0 AS im_1 FROM c GROUP BY 1, 2""")
def multipole_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Moments of parent cells from those of their children, shifted to the parents' centres."""
    child = fields.multipole_moments(_charges(spark, sf), 0.125, 1)
    up = child.withColumn("px", F.floor(F.col("ix") / 2)).withColumn("py", F.floor(F.col("iy") / 2))
    dx, dy = (F.col("ix") + 0.5) * 0.125 - (F.col("px") + 0.5) * 0.25, (F.col("iy") + 0.5) * 0.125 - (F.col("py") + 0.5) * 0.25
    sums = [F.sum("n").alias("n"), F.sum("re_0").alias("q"), F.sum(F.col("re_1") + F.col("re_0") * dx).alias("re_1"), F.sum(F.col("im_1") + F.col("re_0") * dy).alias("im_1")]
    out = up.groupBy(F.col("px").alias("ix"), F.col("py").alias("iy")).agg(*sums)
    return out.select("ix", "iy", "n", F.round("q", 9).alias("q"), (F.round("re_1", 9) + 0.0).alias("re_1"), (F.round("im_1", 9) + 0.0).alias("im_1"))


CELLS = "c AS (SELECT DISTINCT CAST(floor(c_acctbal / 400.0) AS BIGINT) AS ix, CAST(floor(c_nationkey / 1.0) AS BIGINT) AS iy FROM customer)"


@query(f"WITH {CELLS} SELECT a.ix AS ax, a.iy AS ay, count(*) AS n FROM c a JOIN c b ON abs((a.ix >> 1) - (b.ix >> 1)) <= 1 AND abs((a.iy >> 1) - (b.iy >> 1)) <= 1 AND NOT (abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1) GROUP BY 1, 2")
def interaction_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Well-separated cells whose parents touch: an equi-join on neighbouring parents."""
    c = table(spark, sf, "customer").select(cells.cell(F.col("c_acctbal"), 400).alias("ix"), cells.cell(F.col("c_nationkey"), 1).alias("iy")).distinct()
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    one = c.select(F.col("ix").alias("ax"), F.col("iy").alias("ay"), F.explode(shifts).alias("s"))
    one = one.withColumn("px", F.shiftright("ax", 1) + F.col("s.i")).withColumn("py", F.shiftright("ay", 1) + F.col("s.j"))
    two = c.withColumn("px", F.shiftright("ix", 1)).withColumn("py", F.shiftright("iy", 1))
    apart = (F.abs(F.col("ax") - F.col("ix")) > 1) | (F.abs(F.col("ay") - F.col("iy")) > 1)
    return one.join(two, ["px", "py"]).filter(apart).groupBy("ax", "ay").agg(F.count("*").alias("n"))


@query(f"WITH {CELLS}, r AS (SELECT *, ix - row_number() OVER (PARTITION BY iy ORDER BY ix) AS g FROM c) SELECT iy, min(ix) AS first, max(ix) AS last, count(*) AS n FROM r GROUP BY iy, g")
def grid_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of adjoining cells in each row of a grid."""
    c = table(spark, sf, "customer").select(cells.cell(F.col("c_acctbal"), 400).alias("ix"), cells.cell(F.col("c_nationkey"), 1).alias("iy")).distinct()
    run = F.col("ix") - F.row_number().over(Window.partitionBy("iy").orderBy("ix"))
    return c.withColumn("g", run).groupBy("iy", "g").agg(F.min("ix").alias("first"), F.max("ix").alias("last"), F.count("*").alias("n")).drop("g")


@query(SEGMENTS + """, g AS (SELECT user_id, start, row_number() OVER w - 1 AS i, coalesce(lead(start) OVER w, last) - start AS d FROM (SELECT user_id, start, max(t) AS last FROM s GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY start))
SELECT user_id, concat('<?xml version="1.0" encoding="UTF-8"?>\n<MPD type="static" mediaPresentationDuration="PT', sum(d), 'S">\n  <SegmentTimeline>\n', string_agg(concat('    <S d="', d * 1000, '"/>'), '\n' ORDER BY i), '\n  </SegmentTimeline>\n</MPD>') AS manifest FROM g GROUP BY 1""")
def dash_manifest(spark: SparkSession, sf: str) -> DataFrame:
    from meshlark.sources.manifests import dash

    out = _segments(spark, sf)
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array("last"))
    return out.select("user_id", dash(F.zip_with(ends, "starts", lambda e, s: e - s)).alias("manifest"))


@query(f"""WITH {P}, n AS (SELECT a.id, sum(exp(-{D2} / 20.0) * b.u) / sum(exp(-{D2} / 20.0)) AS near FROM p a JOIN p b ON a.id <> b.id AND {D2} <= 25.0 GROUP BY 1)
SELECT p.id, round(greatest(0.0, 0.7 * u + 0.5 * coalesce(near, 0) - 3.0), 8) AS h FROM p LEFT JOIN n USING (id)""")
def message_passing(spark: SparkSession, sf: str) -> DataFrame:
    """One layer: own value, distance-weighted mean of the neighbours, bias, positive part."""
    p = _field(spark, sf)
    near = spatial.class_pairs(p, ["x", "y"], 5.0)
    w = F.col("m") * F.exp(-F.col("distance") * F.col("distance") / 20.0)
    mean = spatial.of_members(near.groupBy("l_id").agg((F.sum(w * F.col("r_u")) / F.sum(w)).alias("near")), p)
    return p.join(mean, "id", "left").select("id", F.round(F.greatest(F.lit(0.0), 0.7 * F.col("u") + 0.5 * F.coalesce("near", F.lit(0.0)) - 3.0), 8).alias("h"))


@query(f"""WITH {P}, m AS (SELECT a.id, avg(exp(-{D2} / 18.0)) AS c FROM p a JOIN p b ON a.id <> b.id AND {D2} <= 36.0 GROUP BY 1)
SELECT CASE WHEN log2(c / 0.4) > 0.5 THEN 'gain' WHEN log2(c / 0.4) < -0.5 THEN 'loss' ELSE 'even' END AS tier, count(*) AS n, round(avg(c), 6) AS mean FROM m GROUP BY 1""")
def contact_map_tiers(spark: SparkSession, sf: str) -> DataFrame:
    p = _field(spark, sf).select("id", "x", "y")
    near = spatial.class_pairs(p, ["x", "y"], 6.0)
    m = near.groupBy("l_id", "l_n").agg((F.sum(F.col("m") * F.exp(-F.col("distance") * F.col("distance") / 18.0)) / F.sum("m")).alias("c"))
    ratio, n = F.log2(F.col("c") / 0.4), F.sum("l_n")
    return m.groupBy(F.when(ratio > 0.5, "gain").when(ratio < -0.5, "loss").otherwise("even").alias("tier")).agg(n.alias("n"), F.round(F.sum(F.col("c") * F.col("l_n")) / n, 6).alias("mean"))


def _vote_step(i: int) -> str:
    return f"""s{i + 1} AS (SELECT k, sum(e / t * x) / sum(e / t) AS pos FROM (SELECT k, x, e, sum(e) OVER (PARTITION BY id) AS t FROM (SELECT c_custkey AS id, c_acctbal / 1000.0 AS x, k, exp(-((c_acctbal / 1000.0 - pos) ** 2) / 4.0) AS e FROM customer, s{i})) GROUP BY k)"""


@query("WITH s0 AS (SELECT r_regionkey AS k, 2.0::DOUBLE * r_regionkey AS pos FROM region), " + ", ".join(_vote_step(i) for i in range(4)) + " SELECT k, round(pos, 6) AS pos FROM s4")
def voting_equilibrium(spark: SparkSession, sf: str) -> DataFrame:
    """Platforms move to the mean of their voters, four times; the few platforms come to the driver between the rounds."""
    voters = table(spark, sf, "customer").select((F.col("c_acctbal") / 1000.0).alias("x"))
    at = {r.r_regionkey: 2.0 * r.r_regionkey for r in table(spark, sf, "region").collect()}
    for _ in range(4):
        e = {k: F.exp(-F.pow(F.col("x") - F.lit(a), F.lit(2.0)) / 4.0) for k, a in at.items()}
        total = sum(e.values(), F.lit(0.0))
        moved = voters.agg(*[(F.sum(v / total * F.col("x")) / F.sum(v / total)).alias(f"k{k}") for k, v in e.items()]).first()
        at = {k: moved[f"k{k}"] for k in at}
    return spark.createDataFrame(sorted((k, round(a, 6)) for k, a in at.items()), "k int, pos double")


@query()
def strand_folding(spark: SparkSession, sf: str) -> DataFrame:
    return dense.folding(dna(spark, sf, "benchmark"), "item_id", "s", 60)


@query()
def spectral_biclusters(spark: SparkSession, sf: str) -> DataFrame:
    return dense.biclusters(table(spark, sf, "customer").withColumn("w", F.lit(1.0)), "c_nationkey", "c_mktsegment", "w", 3)


@query()
def landmark_isomap(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 500.0).alias("x"), (F.col("s_nationkey") * 1.0).alias("y"))
    near = spatial.knn_rings(p, p, ["x", "y"], 6, 12.0).filter("distance <= 12.0").select(F.col("l_id").alias("src"), F.col("r_id").alias("dst"), F.col("distance").alias("w"))
    return dense.isomap(near.union(near.select("dst", "src", "w")), p.select("id"), 2)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, ln(1 + exp(value / 100.0 - 0.5)) AS s, value AS v FROM events),
h AS (SELECT user_id, event_id, i, s * v AS h, v FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, exp(-e.s * 0.3) * h.h + e.s * e.v, e.v FROM h JOIN e ON e.user_id = h.user_id AND e.i = h.i + 1)
SELECT user_id, event_id, round(h + 0.1 * v, 6) AS y FROM h""")
def selective_scan(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("delta", F.col("value") / 100.0 - 0.5)
    return dense.selective_scan(e, "user_id", "event_id", "delta", "value", 0.3, 0.1).withColumn("y", F.round("y", 6))

"""Atoms from fixed-column PDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element, van der Waals radius, mass.
ELEMENTS = [
    ("H", 1.20, 1.008),
    ("C", 1.70, 12.011),
    ("N", 1.55, 14.007),
    ("O", 1.52, 15.999),
    ("S", 1.80, 32.06),
    ("P", 1.80, 30.974),
]
OTHER = (1.70, 12.011)


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """Atoms of the ATOM and HETATM lines; lines whose coordinates are no numbers are left out."""
    at = lambda start, length: F.trim(F.substring(value, start, length))
    number = lambda c, kind: F.expr(f"try_cast({c} AS {kind})")
    rows = lines.filter(F.substring(value, 1, 6).isin("ATOM  ", "HETATM"))
    rows = rows.select(
        at(7, 5).alias("_id"), at(13, 4).alias("atom_name"), at(18, 3).alias("res_name"), at(22, 1).alias("chain"), at(23, 4).alias("_res"),
        at(31, 8).alias("_x"), at(39, 8).alias("_y"), at(47, 8).alias("_z"), at(77, 2).alias("_element"),
    )
    letter = F.regexp_extract("atom_name", "[A-Za-z]", 0)
    rows = rows.withColumn("element", F.upper(F.when(F.length("_element") > 0, F.col("_element")).otherwise(letter)))
    rows = rows.select(
        number("_id", "bigint").alias("atom_id"), "atom_name", "res_name", "chain", number("_res", "int").alias("res_id"), "element",
        number("_x", "double").alias("x"), number("_y", "double").alias("y"), number("_z", "double").alias("z"),
    )
    rows = rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    elements = lines.sparkSession.createDataFrame(ELEMENTS, "element string, radius double, mass double")
    out = rows.join(F.broadcast(elements), "element", "left")  # a fixed few rows
    return out.withColumn("radius", F.coalesce("radius", F.lit(OTHER[0]))).withColumn("mass", F.coalesce("mass", F.lit(OTHER[1])))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))

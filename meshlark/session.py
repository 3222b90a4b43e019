"""Session defaults and table access."""

from __future__ import annotations

import atexit
import shutil
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", **settings: str) -> SparkSession:
    builder = SparkSession.builder.master(master)
    for key, value in (DEFAULTS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share; it goes when the driver ends."""
    root, master = spark.sparkContext.getConf().get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not root:
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir names no folder that the executors of {master} share")
        root = "file:///tmp/checkpoints"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def remove() -> None:
        context = spark.sparkContext
        if context._jsc is not None:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        elif urlparse(path).scheme in ("", "file"):  # the session was stopped; a local folder needs none
            shutil.rmtree(urlparse(path).path, ignore_errors=True)

    atexit.register(remove)
    return path


def stage(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back, to cut the lineage of an iteration."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require(df: DataFrame, *columns: str) -> None:
    """Raises ``ValueError`` for columns that are missing, before any job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")

"""Tables written to the shared folder to cut lineage, and helpers every operator of this subpackage uses."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and all tasks run on this machine, as in tests.
LOCAL_DEFAULT = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir names no folder that the executors of {master} share")
    return (found or LOCAL_DEFAULT).rstrip("/")


#: Removes a statement's shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Scratch:
    """Parquet tables under one folder of the shared directory.

    A table is committed by Spark's writer, so a lost executor costs only its running tasks and later stages never go
    back behind it. ``drop`` removes a table once nothing reads it; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path, names = self.path(name), list(df.columns)
        clash = len({n.lower() for n in names}) < len(names)
        table = by_place(df) if clash else df  # a table's columns have different names
        with _setting(self.spark, CLEANUP, "true"):  # the write's shuffle files go with it: nothing reads behind the table
            table.write.parquet(path)
        out = self.spark.read.schema(table.schema).parquet(path)
        out = out.toDF(*names) if clash else out
        out._scratch_path = path  # noqa: SLF001
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(table._scratch_path)  # noqa: SLF001

    def free_shuffles(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of plans that are no longer referenced."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.root)
        elif urlparse(self.root).scheme in ("", "file"):  # the session was stopped; a local folder needs none
            shutil.rmtree(urlparse(self.root).path, ignore_errors=True)


def released(run):
    """For functions over Arrow batches: gives freed memory back to the system at the end of a task.

    Spark keeps Python workers, and the C library keeps what they freed; a task's peak would else stay with its worker.
    """

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns named ``_in0``, ``_in1`` and so on, so that columns of clashing names do no harm."""
    return df.toDF(*[f"_in{i}" for i in range(len(df.columns))])


def place_of(df: DataFrame, name: str) -> str:
    """The name in ``by_place(df)`` of the first column that is spelled exactly like ``name``."""
    return f"_in{df.columns.index(name)}"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Exactly the named columns (new name = old name), found by exact spelling."""
    return by_place(df).select(*[F.col(place_of(df, old)).alias(new) for new, old in columns.items()])


#: Catalyst's estimates above this say that it knows no size, as of tables made from local rows.
UNKNOWN_BYTES = 1 << 55


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df`` in bytes (file sizes at the leaves)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def tasks_for(df: DataFrame, bytes_each: int) -> int:
    """Shuffle partitions so that each gets about ``bytes_each`` of the input, at least the session's own number."""
    size, least = input_bytes(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size > UNKNOWN_BYTES else max(least, -(-size // bytes_each))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Blocks of one group while these need not grow, and rows of a block at most.
GROUP_BLOCKS, MOST_BLOCK = 32, 1 << 16


def in_block_pairs(members: DataFrame, by: list[str], node: str, block: int, most: int = MOST_BLOCK) -> DataFrame:
    """The members of each group dealt by ``node`` to blocks, once for each pair of blocks (i, j) that holds their block ``own``.

    All pairs of a group meet in some (i, j), and no task needs more than two blocks of it.
    """
    n = members.groupBy(*by).agg(F.count("*").alias("_n"))
    blocks = F.greatest(F.least(F.ceil(F.col("_n") / block), F.lit(GROUP_BLOCKS)), F.ceil(F.col("_n") / most)).cast("int")
    dealt = members.join(n, by).withColumn("_blocks", blocks).withColumn("own", F.pmod(F.xxhash64(node), "_blocks").cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumns({"i": F.least("own", "_other"), "j": F.greatest("own", "_other")}).drop("_n", "_blocks", "_other")

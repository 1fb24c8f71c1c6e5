"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 4000, 8 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python; factloom.batchBytes, where it is set, is the bound of their bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("factloom.batchBytes", str(BATCH_BYTES)))


def release() -> None:
    """Give freed memory of this process back to the system: a worker is used again by other stages, beside the JVM."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; one of our own only where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/factloom-{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """The path of a shared folder for programs that map files into memory."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: memory mapping needs a shared folder that is mounted as a file system")
    return uri


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (with __ for .) that hold inside a with block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stash(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and a lost executor costs nothing.

    Spark deletes the shuffle files of the write when it ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame) -> int:
    """UTF-8 bytes of column text, summed over all rows."""
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), component the smallest node reachable.

    Alternating large-star and small-star rounds: each round joins edges with the minimum of each node's
    neighbours, which is aggregated before the shuffle, so a node with very many edges is no hot group.
    Edges lead from the larger to the smaller node; the rounds end when nothing changes.
    """

    def low(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m"))

    def digest(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = stash(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = digest(e)
    while seen[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = low(both.union(both.select("a", F.col("a").alias("b"))))
        large = both.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        m = low(large)
        small = large.join(m, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(m.select("a", F.col("m").alias("b")))
        e = stash(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = digest(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)



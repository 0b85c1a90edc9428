"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can read: spark.checkpoint.dir.

    Only where it is unset and the master is local, as in tests, a temporary folder is made and set; on a cluster that raises, as executors wouldn't see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tesserae/{tag}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors. The table stays, as the result may be read at any time."""
    return _written(df, shared_path(df.sparkSession, tag))


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


class Steps:
    """Durable tables of one run that go when they aren't needed any more."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, {}

    def __call__(self, df: DataFrame, tag: str) -> DataFrame:
        """materialize(), until drop()."""
        path = shared_path(self._spark, tag)
        out = _written(df, path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, or all; none may be read after."""
        for key in [id(t) for t in tables] or list(self._paths):
            remove(self._spark, self._paths.pop(key)[1])


@contextmanager
def steps(spark: SparkSession) -> Iterator[Steps]:
    """Steps whose tables are all gone afterwards: what is to outlast them is materialized inside."""
    out = Steps(spark)
    try:
        yield out
    finally:
        out.drop()


def trimmed(run):
    """The function from batches to batches, which in the end gives the memory it has freed back to the system: Python workers live on between stages, beside other tasks."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not every C library has it
                pass

    return go


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of queries that have ended."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it different from all columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
        taken.add(n.lower())
    return out


def byte_words(part_of_word: Callable[[int], bool]) -> Callable[[bytes], list[bytes]]:
    """A function from UTF-8 to the words in it, A-Z lower-cased: runs of bytes that belong to words, all beyond ASCII or none of them."""
    table = bytes(ord(chr(b).lower()) if part_of_word(b) and b < 128 else b if part_of_word(b) else 32 for b in range(256))
    return lambda text: text.translate(table).split()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def about(key: str, wanted: int, total: int) -> Column:
    """Whether a row is among about three times `wanted` of `total`, by a hash of its key: rows to take the first `wanted` from, so that no more
    than these reach the driver from all tasks together."""
    million = 1_000_000
    return F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(million)) < math.ceil(million * min(1.0, 3 * wanted / max(total, 1)))

"""Cutting lineage so that it survives lost executors: tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below spark.checkpoint.dir. Only where that is unset and the master is local, as in tests, a temporary folder is made; on a cluster that raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tables/{tag}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """df, written and read back as Parquet. The table stays, as the result may be read at any time."""
    return _written(df, shared_path(df.sparkSession, tag))


class Steps:
    """Durable tables that go when their successors are there."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, {}

    def __call__(self, df: DataFrame, tag: str = "step") -> DataFrame:
        path = shared_path(self._spark, tag)
        out = _written(df, path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, or all; none may be read after."""
        for key in [id(t) for t in tables] or list(self._paths):
            where = self._spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(key)[1])
            where.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@contextmanager
def steps(spark: SparkSession) -> Iterator[Steps]:
    """Steps whose tables are all gone afterwards: what is to outlast them is materialized inside."""
    out = Steps(spark)
    try:
        yield out
    finally:
        out.drop()

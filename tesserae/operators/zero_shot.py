"""Labels that training has not seen, by a linear map from text vectors to label vectors.

Fitting sums outer products of vectors in the executors, a matrix of the width of the vectors for each task; the sums are merged by their rows, and one small system is solved on the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tesserae.operators.retrieval import _flat

#: Bytes of label vectors that every task gets at once.
LABEL_BYTES = 1 << 26


def gram(rows: DataFrame, x: str, y: str) -> np.ndarray:
    """The sum over the rows of the outer products of two vectors, width of x by width of y; rows with a null vector are left out, without rows it is 0-sized."""
    known = rows.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = _flat(batch.column(0)).T @ _flat(batch.column(1))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    made = known.mapInArrow(sums, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    merged = made.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if not len(merged):
        return np.zeros((0, 0))
    out = np.zeros((merged["i"].max() + 1, merged["j"].max() + 1))
    out[merged["i"], merged["j"]] = merged["v"]
    return out


def fit(rows: DataFrame, x: str = "x", y: str = "y", ridge: float = 1.0) -> np.ndarray:
    """The map W, width of x by width of y, that makes the sum of (xW - y)² + ridge * W² least. Rows with a null vector are left out; without rows W is 0-sized. Vectors of a column have one width."""
    known = rows.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    both = gram(known.select("x", F.concat("x", "y").alias("xy")), "x", "xy")
    n = len(both)
    return np.linalg.solve(both[:, :n] + ridge * np.eye(n), both[:, n:]) if n else both


def predict(rows: DataFrame, weights: np.ndarray, x: str = "x", into: str = "predicted") -> DataFrame:
    """rows with the vector xW; null stays null."""
    rows = rows.drop(into)
    sent = rows.sparkSession.sparkContext.broadcast(weights)
    at, schema = rows.columns.index(x), StructType([*rows.schema.fields, StructField(into, ArrayType(DoubleType()))])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            column = batch.column(at)
            there = np.flatnonzero(np.array(column.is_valid()))
            made: list = [None] * batch.num_rows
            for i, v in zip(there.tolist(), (_flat(column.take(pa.array(there))) @ w).tolist() if len(there) else []):
                made[i] = v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], schema.names)

    return rows.mapInArrow(go, schema)


def match(rows: DataFrame, weights: np.ndarray, labels: DataFrame, k: int, key: str = "doc_id", x: str = "x", most_bytes: int = LABEL_BYTES) -> DataFrame:
    """(key, label, score, place): for each row the k labels (label, y) whose vectors are most like xW by cosine; ties go by label. Labels needn't have been in fit().

    Every task gets the label vectors in blocks of at most about most_bytes, and keeps k of each block for a row. Rows and labels without a vector, or with one of zeros, are left out.
    """
    spark = rows.sparkSession
    labels = labels.select("label", F.col("y").cast("array<double>").alias("y")).where(F.exists("y", lambda v: v != 0))
    size = labels.agg(F.coalesce(F.sum(8 * F.size("y").cast("long")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // most_bytes))
    rows = rows.select(key, F.col(x).cast("array<double>").alias("x")).where(F.exists("x", lambda v: v != 0))
    kinds = {f.name: f.dataType.simpleString() for f in (*rows.schema, *labels.schema)}
    found = None
    for b in range(blocks):
        own = labels.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == b).orderBy("label").toArrow()
        if not own.num_rows:
            continue
        sent = spark.sparkContext.broadcast((weights, own))

        def go(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            w, table = sent.value
            names, y = table.column(0).combine_chunks(), _flat(table.column(1).combine_chunks())
            y = y / np.sqrt((y * y).sum(axis=1, keepdims=True))
            best = min(k, len(y))
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    p = _flat(part.column(1)) @ w
                    norm = np.sqrt((p * p).sum(axis=1, keepdims=True))
                    scores = (p / np.where(norm > 0, norm, 1)) @ y.T
                    order = np.argsort(-scores, axis=1, kind="stable")[:, :best]
                    yield pa.record_batch([part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), best))), names.take(pa.array(order.ravel())), pa.array(np.take_along_axis(scores, order, 1).ravel())], [key, "label", "score"])

        part = rows.mapInArrow(go, f"`{key}` {kinds[key]}, label {kinds['label']}, score double")
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], f"`{key}` {kinds[key]}, label {kinds['label']}, score double, place int")
    order = Window.partitionBy(key).orderBy(F.desc("score"), "label")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

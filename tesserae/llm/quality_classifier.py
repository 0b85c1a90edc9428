"""Quality by compression.

Two zstandard dictionaries are built from texts labelled good and bad. A text is compressed with either and with none; the difference
of the two sizes over the third says whose wording it shares. A logistic regression over it, its square, and how far the text
compresses at all gives the calibrated score. It is fitted on labelled texts that no dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import about, materialize, trimmed


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    level: int
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  # the last is the constant
    constant: float | None = None  # the score of every text, where there was nothing to learn from


class Sizes:
    """Compressed sizes of texts; rows: by the good dictionary, the bad one, none."""

    def __init__(self, good: bytes, bad: bytes, level: int):
        import zstandard as z

        def by(data: bytes | None):
            d = z.ZstdCompressionDict(data) if data else None
            if d is not None:
                d.precompute_compress(level=level)
            return z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False) if d else z.ZstdCompressor(level=level, write_content_size=False)

        self._by = [by(good), by(bad), by(None)]

    def features(self, texts: list[bytes]) -> np.ndarray:
        got = np.array([[len(c.compress(t)) for c in self._by] for t in texts], float).reshape(-1, 3)
        n = np.array([len(t) for t in texts], float)
        difference = (got[:, 1] - got[:, 0]) / np.maximum(got[:, 2], 1)
        squeeze = np.log((got[:, 2] + 16) / (n + 16))
        return np.stack([difference, difference**2, squeeze, squeeze**2, difference * squeeze], axis=1)


def _dictionary(texts: list[bytes], size: int, piece: int = 2048) -> bytes:
    """A trained dictionary, or where zstandard finds too little, the texts' own last bytes."""
    import zstandard as z

    pieces = [t[i : i + piece] for t in texts for i in range(0, len(t), piece)]
    try:
        return z.train_dictionary(size, pieces, level=3).as_bytes()
    except z.ZstdError:
        return b"\n".join(texts)[-size:] or b" " * 8


def fit(rows: list[tuple[str, int]], size: int = 112_640, level: int = 3, steps: int = 30, ridge: float = 1e-2) -> Model:
    """rows: texts and labels 0 or 1. Every other text of a class goes to its dictionary, the rest to the regression."""
    by = {y: [t.encode() for t, l in rows if l == y] for y in (0, 1)}
    if min(map(len, by.values())) < 2:
        n = len(rows)
        return Model(b"", b"", level, (), (), (), (sum(y for _, y in rows) + 1) / (n + 2))
    good, bad = (_dictionary(by[y][::2], size) for y in (1, 0))
    sizes = Sizes(good, bad, level)
    x = np.concatenate([sizes.features(by[y][1::2]) for y in (0, 1)])
    y = np.repeat([0.0, 1.0], [len(by[0][1::2]), len(by[1][1::2])])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return Model(good, bad, level, tuple(centre), tuple(scale), tuple(w))


def predict(model: Model, texts: list[str | None], sizes: Sizes | None = None) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    x = (sizes or Sizes(model.good, model.bad, model.level)).features([(t or "").encode() for t in texts])
    x = (x - model.centre) / model.scale
    w = np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, rows_per_class: int = 1500, max_chars: int = 40_000) -> list[tuple[str, int]]:
    """One labelled text of at most rows_per_class documents of each class, by a digest's order: what a fit may see. Of a longer text max_chars from its middle.

    Rows of a doc_id with crc32 modulo 3 of 1 are held out; labels other than 0 and 1 and null ids or texts are passed over. Of several texts of a doc_id the first by digest counts.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.min("y").alias("y")).join(texts.select("doc_id"), "doc_id", "left_semi").withColumn("o", F.md5(F.col("doc_id").cast("string")))
    marked = materialize(marked, "labels")
    found = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    chosen = [r for y in found for r in marked.where((F.col("y") == y) & about("doc_id", rows_per_class, found[y])).orderBy("o").limit(rows_per_class).collect()]
    if not chosen:
        return []
    few = F.broadcast(spark.createDataFrame([(r.doc_id, r.y, r.o) for r in chosen], "doc_id long, y int, o string"))
    piece = F.substring("text", F.greatest(F.floor((F.length("text") - max_chars) / 2), F.lit(0)).cast("int") + 1, F.lit(max_chars))
    got = texts.join(few, "doc_id").select("y", "o", piece.alias("text"), F.md5("text").alias("d")).groupBy("y", "o").agg(F.min_by("text", "d").alias("text")).collect()
    return [(r.text, r.y) for r in sorted(got, key=lambda r: r.o)]


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: Model, targets: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (0 to 1) and predicted (0 or 1), or other names, after its columns, of which they replace those of their names; null texts count as empty."""
    names = [c for c in docs.columns if c.lower() not in targets]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    text = [c.lower() for c in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes = Sizes(m.good, m.bad, m.level) if m.constant is None else None
        for batch in batches:
            s = predict(m, batch.column(text).to_pylist(), sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*names, *targets])

    schema = T.StructType([*docs.schema.fields, T.StructField(targets[0], T.DoubleType()), T.StructField(targets[1], T.IntegerType())])
    return docs.mapInArrow(trimmed(run), schema)


def classify(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; other columns of docs are ignored, repeated rows are scored each by itself."""
    model = fit(sample(docs, labels, **bounds))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return score(rows, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")

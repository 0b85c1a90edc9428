"""Vectors compressed to short codes: one byte for each of a few equal parts, by integer codebooks.

Components become integers, and a codebook for each part starts from the parts of the smallest keys. In each round the codebooks (at most parts x entries x part length integers) are broadcast; every task takes Arrow
batches of vectors, computes all distances by |x|² - 2 x·c + |c|² with exact int64 matrix products, takes the first nearest entry, and gives the sum and number of parts of every entry, which a grouped shuffle
merges. So no row moves, and what reaches the driver has the size of the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from tesserae.llm.common import fresh, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors whose distances are held at once.
STEP = 2048
#: Groups of equal labels that are broadcast, at most 30 bytes each; more are joined by a shuffle.
FEW = 200_000
#: Scaled components of this size and more count as infinite, so that the sums of all rows stay exact.
VAST = 1e27


def usable(vector: Column, scale: int = SCALE) -> Column:
    """Whether the vector is there and every component is a finite number."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * scale >= VAST))


def _integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component: int64, or Python's integers where squares could pass int64."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width) * scale)
    if len(x) and width and np.abs(x).max() * np.sqrt(width) >= 2.0**30:
        return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return x.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row of x the nearest entry, the first of several, and its squared distance."""
    wide = x.dtype == object or book.dtype == object or (book.size and np.abs(book).max() * np.sqrt(book.shape[1]) >= 2.0**30)
    kind = object if wide else np.int64
    book, found, error = book.astype(kind), np.zeros(len(x), np.int64), np.zeros(len(x), kind)
    norms = (book * book).sum(axis=1)
    for a in range(0, len(x), STEP):
        part = x[a : a + STEP].astype(kind)
        d = norms - 2 * (part @ book.T) if book.shape[1] else np.zeros((len(part), len(book)), kind)
        best = d.argmin(axis=1)
        found[a : a + STEP] = best
        error[a : a + STEP] = d[np.arange(len(part)), best] + (part * part).sum(axis=1)
    return found, error


def _cuts(width: int, parts: int) -> list[slice]:
    return [slice(width * p // parts, width * (p + 1) // parts) for p in range(parts)]


class Codebooks:
    """books: for each part an array of entries x part length, integers."""

    def __init__(self, books: list[np.ndarray], width: int, scale: int):
        self.books, self.width, self.scale = books, width, scale

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.books for v in book.ravel()).encode()).hexdigest()


def _vectors(df: DataFrame, vector: str, width: int | None, scale: int) -> DataFrame:
    """Rows with a usable vector of this width, which becomes one of doubles."""
    out = df.withColumn(vector, F.col(f"`{vector}`").cast("array<double>")).where(usable(F.col(f"`{vector}`"), scale))
    return out if width is None else out.where(F.size(f"`{vector}`") == width)


def train(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks after so many rounds; None without a usable vector.

    They start from the `entries` smallest keys, ascending, null keys last and repeated ones by their components; with fewer rows there are fewer entries. An entry's next value is the floor of its parts' mean, an
    entry without parts stays. Rounds end early when nothing changes any more. df is read once for each round and once for the start.
    """
    rows = _vectors(df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{vector}`").alias("v")), "v", None, scale)
    first = rows.orderBy(F.col("k").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return None
    width = len(first[0].v)
    rows = rows.where(F.size("v") == width)
    cuts, sc = _cuts(width, parts), rows.sparkSession.sparkContext
    seeds = np.array([[int(np.floor(x * scale)) for x in r.v] for r in rows.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()], dtype=object)
    books = [seeds[:, c] for c in cuts]
    lengths = sorted({c.stop - c.start for c in cuts})
    for _ in range(rounds):
        sent = sc.broadcast([_narrow(b) for b in books])

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            total = [np.zeros(b.shape, object) for b in own]
            count = [np.zeros(len(b), np.int64) for b in own]
            for batch in batches:
                x = _integers(batch.column(0), width, scale)
                if not len(x):
                    continue
                for p, (cut, book) in enumerate(zip(cuts, own)):
                    best, _ = nearest(x[:, cut], book)
                    order = np.argsort(best, kind="stable")
                    found, starts = np.unique(best[order], return_index=True)
                    if cut.stop > cut.start:
                        total[p][found] += np.add.reduceat(x[order, cut], starts, axis=0).astype(object)
                    count[p][found] += np.diff([*starts, len(best)])
            rows = [(p, e, int(count[p][e]), [int(v) for v in total[p][e]]) for p in range(len(own)) for e in np.flatnonzero(count[p]).tolist()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))])], ["part", "entry", "n", "total"])

        made = rows.select("v").mapInArrow(sums, "part int, entry int, n long, total array<decimal(38,0)>")
        merged = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(lengths[-1]))).alias("total"))
        after = [b.copy() for b in books]
        for r in merged.collect():
            after[r.part][r.entry] = [int(v) // r.n for v in r.total[: cuts[r.part].stop - cuts[r.part].start]]
        sent.unpersist()
        if all((a == b).all() for a, b in zip(after, books)):
            break
        books = after
    return Codebooks([_narrow(b) for b in books], width, scale)


def _narrow(book: np.ndarray) -> np.ndarray:
    """int64 where the entries fit with their squares."""
    return book if book.size and max(map(abs, book.ravel().tolist())) >= 2**28 else book.astype(np.int64)


def encode(df: DataFrame, model: Codebooks | None, vector: str = "embedding", names: tuple[str, str] = ("code", "error")) -> DataFrame:
    """df's rows with a usable vector of the model's width, and the code (two hex digits for each part) and the squared distance to what it stands for, null beyond a long.

    Rows whose vector is null or holds null, non-finite or vast components go, as do those of another length than the smallest key's vector; repeated rows stay. Columns in the way of the two new ones are replaced.
    """
    out = _vectors(df.drop(*names), vector, -1 if model is None else model.width, SCALE if model is None else model.scale)
    (at,) = fresh(out, "_integers_of")
    schema = out.drop(vector).schema.add(StructField(names[0], StringType())).add(StructField(names[1], LongType()))
    if model is None:
        return out.sparkSession.createDataFrame([], schema)
    sent, width, scale = out.sparkSession.sparkContext.broadcast(model.books), model.width, model.scale

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        cuts = _cuts(width, len(books))
        for batch in batches:
            x, last = _integers(batch.column(batch.num_columns - 1), width, scale), batch.num_columns - 1
            got = [nearest(x[:, c], b) for c, b in zip(cuts, books)]
            digits = np.stack([g[0] for g in got], axis=1).astype(np.uint8)
            text = digits.tobytes().hex()
            step = 2 * len(books)
            error = sum((g[1].astype(object) for g in got), np.zeros(len(x), object))
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array([text[i * step : (i + 1) * step] for i in range(len(x))], pa.string()), pa.array([e if e < 2**63 else None for e in error.tolist()], pa.int64())], [*batch.schema.names[:last], *names])

    return out.withColumn(at, F.col(f"`{vector}`")).drop(vector).mapInArrow(code, schema)


def decode(df: DataFrame, model: Codebooks, code: str = "code", into: str = "decoded") -> DataFrame:
    """df with the vector that each code stands for: the middle of its integers' cells, over the scale."""
    books = [F.array(*(F.array(*(F.lit((int(v) + 0.5) / model.scale) for v in entry)) for entry in book)) for book in model.books]
    at = [F.conv(F.substring(f"`{code}`", 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(books))]
    return df.withColumn(into, F.concat(*(F.get(b, a) for b, a in zip(books, at))))


def report(df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (error summed over the rows of the label, null labels together; null beyond a long) and codebooks_sha256."""
    rows = df.select("vec_id", "label", "embedding")
    model = train(rows)
    coded = materialize(encode(rows, model), "vector_codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    sums = F.broadcast(sums) if sums.limit(FEW + 1).count() <= FEW else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").select("vec_id", "code", "error", "label_error", F.lit(model.sha256 if model else None).cast("string").alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    near = "SELECT r, p, min(struct_pack(d := d, e := e)) AS best FROM (SELECT r, p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM parts JOIN book{k} USING (p)) GROUP BY r, p"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT r, p, v[len(v) * p // {parts} + 1 : len(v) * (p + 1) // {parts}] AS x FROM kept, range({parts}) t(p))",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {entries})",
    ]
    for k in range(rounds):
        steps += [
            f"near{k} AS MATERIALIZED ({near.format(k=k)})",
            f"sums{k} AS (SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM near{k} JOIN parts USING (r, p), LATERAL unnest(range(1, len(x) + 1)) u(i) GROUP BY 1, 2, 3)",
            f"moved{k} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM sums{k} GROUP BY 1, 2)",
            f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN moved{k} m USING (p, e))",
        ]
    return (
        "WITH "
        + ",\n".join([*steps, f"last AS MATERIALIZED ({near.format(k=rounds)})", "coded AS (SELECT r, string_agg(format('{:02x}', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM last GROUP BY r)"])
        + f"""
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""
    )


SQL = _sql()

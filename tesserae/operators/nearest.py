"""The exact nearest neighbours of all rows by cosine, with both sides distributed.

Equal vectors are one row to begin with. A few vectors are pivots; every row knows its distances to them, lies in the cell of the nearest one, and rows of a cell, in the order of that distance, form blocks. A block has the
least and the largest distance to each pivot over its rows, and by the triangle inequality two blocks whose intervals stand apart have no closer rows than the gap. Within its own block a row finds k neighbours, which bound
the distance it is looking for; pairs of cells, then of blocks, whose gap is beyond the bounds are never met. The others meet once, for both directions. Where vectors have no structure the bounds settle little, and most
pairs of blocks meet: then the work is that of all pairs, in block products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.retrieval import _flat
from tesserae.plans.durable import Steps, materialize

#: Rows of a block at most; pivots at most, and rows for each of them.
BLOCK, PIVOTS, ROWS_A_PIVOT = 1024, 128, 4096
#: Bytes of vectors of a group of blocks, of which a task holds two.
GROUP_BYTES = 1 << 26
#: Distances within this of a bound aren't told apart from it.
SLACK = 1e-9


@dataclass
class Neighbours:
    """result: (key, other, score, top_similarity). work: one row (classes, blocks, block_pairs, met, compared): how many different vectors, blocks and pairs of blocks there are, how many of these met, and pairs of vectors compared."""

    result: DataFrame
    work: DataFrame


def _unit(column: pa.Array) -> np.ndarray:
    rows = _flat(column)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * a @ b.T))


def _blocks(pivots: np.ndarray, most: int, k: int):
    """Blocks of rows that come by cell and distance: id, cell, class ids, vectors, intervals of distances to the pivots, and for each row the bound on its k-th neighbour's distance."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, cell = TaskContext.get().partitionId() << 33, [], None

        def block() -> pa.RecordBatch:
            nonlocal number, held
            ids, x = np.array([r[0] for r in held]), np.array([r[1] for r in held])
            d = _apart(x, pivots)
            own = _apart(x, x)
            bound = np.full(len(x), np.inf) if len(x) <= k else np.sort(own, axis=1)[:, k]
            number += 1
            held = []
            return pa.record_batch(
                [pa.array([number - 1], pa.int64()), pa.array([cell], pa.int32()), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([d.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([d.max(axis=0).tolist()], pa.list_(pa.float64())), pa.array([bound.tolist()], pa.list_(pa.float64()))],
                ["block", "cell", "ids", "vectors", "low", "high", "bound"],
            )

        for batch in batches:
            cells, ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), _flat(batch.column(2))
            for c, i, x in zip(cells, ids, rows):
                if held and (c != cell or len(held) >= most):
                    yield block()
                cell = c
                held.append((i, x))
        if held:
            yield block()

    return go


_BLOCK = "block long, cell int, ids array<long>, vectors binary, low array<double>, high array<double>, bound array<double>"
_FOUND = "a long, b long, score double, compared long"


def _best(i: np.ndarray, j: np.ndarray, s: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, other, score) the k highest of each row, more only where the last one ties; least rises to the k-th score of the rows that have so many."""
    order = np.lexsort((-s, i))
    i, j, s = i[order], j[order], s[order]
    start = np.searchsorted(i, i)
    full = np.flatnonzero(np.arange(len(i)) - start == k - 1)
    least[i[full]] = np.maximum(least[i[full]], s[full] - SLACK)
    kept = s >= least[i]
    return i[kept], j[kept], s[kept]


def _meet(k: int):
    """Of the blocks of a pair of groups and the list of those of them that meet: the rows that are within each other's bounds, k of each row at most; and a row with the number of pairs compared."""

    def go(blocks: pa.Table, pairs: pa.Table) -> pa.Table:
        blocks = blocks.combine_chunks()
        at = {b: n for n, b in enumerate(blocks["block"].to_pylist())}
        ids = [np.array(x.values.to_numpy(), np.int64) for x in blocks["ids"]]
        vectors = [np.frombuffer(x.as_buffer()).reshape(len(ids[n]), -1) for n, x in enumerate(blocks["vectors"])]
        limits = [np.array(x.values.to_numpy()) + SLACK for x in blocks["bound"]]
        least = [np.maximum(-1.0 - SLACK, 1 - x * x / 2 - SLACK) for x in limits]  # as similarities
        found = [[] for _ in ids]
        compared = 0

        def add(of: int, other: int, scores: np.ndarray) -> None:
            i, j = np.nonzero(scores >= least[of][:, None])
            if len(i) > 2 * k * len(scores):
                # more than k only where the last one ties
                take = min(k, scores.shape[1])
                kth = np.partition(scores, scores.shape[1] - take, axis=1)[:, scores.shape[1] - take]
                i, j = np.nonzero(scores >= np.maximum(least[of], kth - SLACK)[:, None])
            s = scores[i, j]
            good = np.isfinite(s)
            found[of].append((i[good], ids[other][j[good]], s[good]))
            if sum(len(x[0]) for x in found[of]) > 4 * k * len(scores):
                found[of] = [_best(*(np.concatenate(x) for x in zip(*found[of])), k, least[of])]

        for meeting in pairs["pairs"].to_pylist():
            for pair in meeting:
                a, b = at[pair["x_block"]], at[pair["y_block"]]
                scores = vectors[a] @ vectors[b].T
                if a == b:
                    np.fill_diagonal(scores, -np.inf)
                    compared += len(scores) * (len(scores) - 1) // 2
                else:
                    add(b, a, scores.T)
                    compared += scores.size
                add(a, b, scores)
        best = [_best(*(np.concatenate(x) for x in zip(*f)), k, least[n]) if f else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for n, f in enumerate(found)]
        i, j, s = (np.concatenate(x) for x in zip(*((ids[n][i], j, s) for n, (i, j, s) in enumerate(best))))
        rows = pa.table({"a": i, "b": j, "score": s, "compared": np.zeros(len(i), np.int64)})
        return pa.concat_tables([rows, pa.table([[None], [None], [None], [compared]], schema=rows.schema)])

    return go


def neighbours(df: DataFrame, key: str, k: int, vector: str = "embedding", block: int = BLOCK, pivots: int | None = None, digits: int = 12) -> Neighbours:
    """For each row the k others nearest by cosine, ties (similarities equal to `digits`) by key.

    Rows whose vector is null, empty, of zeros or not finite are left out; keys are taken to be unique. pivots: their number, by default one for ROWS_A_PIVOT different vectors, PIVOTS at most; these few vectors are
    all that reaches the driver.
    """
    spark = df.sparkSession
    step = Steps(spark)
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("key"), v.alias("v")).where(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = rows.withColumn("h", F.xxhash64("v"))
    # a class is its vector; its smallest key stands for it, and its k + 1 smallest are all that anyone needs
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("h", "v").orderBy("key"))).where(F.col("_r") <= k + 1)
    classes = ranked.groupBy("h", "v").agg(F.array_sort(F.collect_list("key")).alias("keys")).withColumn("id", F.xxhash64(F.col("keys")[0], "h"))
    classes = step(classes, "classes")
    n = classes.count()
    wanted = min(PIVOTS, max(1, n // ROWS_A_PIVOT)) if pivots is None else pivots
    chosen = _unit(classes.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(wanted).select("v").toArrow().column(0).combine_chunks()) if n else np.zeros((1, 1))
    sent = spark.sparkContext.broadcast(chosen)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = _unit(part.column(1))
                d = _apart(x, sent.value)
                cell = d.argmin(axis=1)
                yield pa.record_batch([pa.array(cell, pa.int32()), part.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(d[np.arange(len(x)), cell])], ["cell", "id", "x", "d"])

    placed = classes.select("id", "v").mapInArrow(place, "cell int, id long, x array<double>, d double")
    dealt = placed.repartitionByRange("cell", "d", "id").sortWithinPartitions("cell", "d", "id").select("cell", "id", "x")
    blocks = step(dealt.mapInArrow(lambda b: _blocks(sent.value, block, k)(b), _BLOCK), "blocks")
    slim = blocks.select("block", "cell", "low", "high", F.array_max("bound").alias("bound"))
    cells = slim.groupBy("cell").agg(
        F.array(*(F.min(F.col("low")[p]) for p in range(len(chosen)))).alias("low"), F.array(*(F.max(F.col("high")[p]) for p in range(len(chosen)))).alias("high"), F.max("bound").alias("bound")
    )
    of_cells = cells.toPandas()  # a row for each pivot
    near = [
        (int(a.cell), int(b.cell))
        for a in of_cells.itertuples()
        for b in of_cells.itertuples()
        if max(0.0, *(max(x - y, z - w) for x, y, z, w in zip(a.low, b.high, b.low, a.high))) <= max(a.bound, b.bound) + SLACK
    ]
    near = F.broadcast(spark.createDataFrame(near, "x_cell int, y_cell int"))
    x, y = (slim.withColumnsRenamed({c: f"{s}_{c}" for c in slim.columns}) for s in "xy")

    def over(low: str, high: str):
        return F.array_max(F.zip_with(low, high, lambda a, b: a - b))

    gap = F.greatest(over("x_low", "y_high"), over("y_low", "x_high"))
    pairs = x.join(near, "x_cell").join(y, "y_cell").where((F.col("x_block") <= F.col("y_block")) & ((F.col("x_block") == F.col("y_block")) | (gap <= F.greatest("x_bound", "y_bound") + SLACK)))
    pairs = step(pairs.select("x_block", "y_block"), "block-pairs")
    # blocks in their order form groups; all blocks of two groups that meet lie in one task, so a block is sent once for each group, and its rows keep k neighbours for each group, not for each block
    blocks_n, pairs_n = blocks.count(), pairs.count()
    groups = max(1, -(-blocks_n * block * 8 * chosen.shape[1] // GROUP_BYTES), min(blocks_n, math.isqrt(6 * spark.sparkContext.defaultParallelism)))
    number = F.floor((F.row_number().over(Window.orderBy("block")) - 1) * groups / max(blocks_n, 1)).cast("int")  # a row for each block
    group = step(blocks.select("block", number.alias("group")), "groups")
    gx, gy = (F.broadcast(group.select(F.col("block").alias(f"{s}_block"), F.col("group").alias(f"{s}_group"))) for s in "xy")
    dealt = step(pairs.join(gx, "x_block").join(gy, "y_block"), "dealt-pairs")
    cell = ["x_group", "y_group"]
    meetings = dealt.groupBy(*cell).agg(F.collect_list(F.struct("x_block", "y_block")).alias("pairs"))
    own = ["of_x", "of_y"]
    asked = dealt.select(*(F.col(c).alias(o) for c, o in zip(cell, own)), F.explode(F.array("x_block", "y_block")).alias("block")).distinct()
    sent_blocks = blocks.select("block", "ids", "vectors", "bound").join(F.broadcast(asked), "block")
    met = sent_blocks.groupBy(*own).cogroup(meetings.groupBy(*cell)).applyInArrow(_meet(k), _FOUND)
    met = step(met, "met")
    score = F.round("score", digits)
    best = Window.partitionBy("a").orderBy(F.desc(score), "first")
    owners = classes.select(F.col("id").alias("b"), F.col("keys")[0].alias("first"), F.col("keys").alias("others"))
    found = met.where("a IS NOT NULL").join(owners, "b").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    lists = found.groupBy("a").agg(F.collect_list(F.struct("score", "others")).alias("found"))
    own = classes.select("id", "h", "v", "keys").join(lists, F.col("id") == F.col("a"), "left").withColumn("found", F.concat(F.array(F.struct(F.lit(1.0).alias("score"), F.col("keys").alias("others"))), F.coalesce("found", F.array().cast(lists.schema["found"].dataType))))
    each = rows.join(own.withColumnRenamed("h", "_h").withColumnRenamed("v", "_v"), (F.col("h") == F.col("_h")) & (F.col("v") == F.col("_v")))
    near_rows = F.flatten(F.transform("found", lambda s: F.transform(s["others"], lambda o: F.struct(s["score"].alias("score"), o.alias("other")))))
    listed = each.select("key", F.filter(near_rows, lambda s: s["other"] != F.col("key")).alias("near"))
    cut = F.slice(F.transform(F.array_sort(F.transform("near", lambda s: F.struct((-F.round(s["score"], digits)).alias("order"), s["other"].alias("other"), s["score"].alias("score")))), lambda s: F.struct(s["other"], s["score"])), 1, k)
    result = materialize(listed.select("key", F.explode(cut).alias("n"), F.array_max(F.transform("near", lambda s: s["score"])).alias("top_similarity")).select(F.col("key").alias(key), "n.other", "n.score", "top_similarity"), "neighbours")
    compared = met.agg(F.coalesce(F.sum("compared"), F.lit(0))).first()[0]
    step.drop()
    return Neighbours(result, spark.createDataFrame([(n, blocks_n, blocks_n * (blocks_n + 1) // 2, pairs_n, compared)], "classes long, blocks long, block_pairs long, met long, compared long"))

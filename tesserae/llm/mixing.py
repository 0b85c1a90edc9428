"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only.

The documents of a source, in an order by digest, form blocks. With weight w, its share of the sum, block j (from 1) of a source is released at slot floor((j - 1) / w), is due by slot
ceil(j / w), and the earliest deadline among the released blocks takes each slot; then after any number of slots each source has had its weighted share to less than one
block, as long as none is used up. Weights are exact fractions, so no error builds up.
The blocks that exist are planned on the driver as part of the query plan, in time by their number (a block is some documents) and in
memory by the number of sources and CHUNK slots; each block finds its slot by a join with the plan. A source that is used up leaves its slots empty, and the others close up in their order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import fresh, shared_path

CHUNK = 1 << 20  # blocks of the plan that the driver holds at once
DIGITS = 3  # of the digest that deal a source's documents to 16 ** DIGITS runs, of which each is sorted by itself


def _parts(weights: dict) -> dict:
    """The weights as whole numbers, in exact proportion."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be above 0")
    scale = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


class _Earliest:
    """Earliest deadline first; the state between slots."""

    def __init__(self, part: dict):
        self._part, self._total, self.slot = part, sum(part.values()), 0
        self.pending, self.ready = [(0, -(-self._total // c), str(s), 0, s) for s, c in part.items()], []
        heapq.heapify(self.pending)

    def run(self, blocks: dict) -> Iterator[tuple]:
        """Until the blocks are used up."""
        while self.pending or self.ready:
            if not self.ready:
                self.slot = max(self.slot, self.pending[0][0])
            while self.pending and self.pending[0][0] <= self.slot:
                release, deadline, name, j, s = heapq.heappop(self.pending)
                heapq.heappush(self.ready, (deadline, name, j, release, s))
            deadline, name, j, release, s = heapq.heappop(self.ready)
            if (k := j + 1) < blocks[s]:
                heapq.heappush(self.pending, (k * self._total // self._part[s], -(-(k + 1) * self._total // self._part[s]), name, k, s))
            yield s, j, self.slot, release, deadline
            self.slot += 1


def plan(weights: dict, blocks: dict) -> Iterator[tuple]:
    """(source, its block from 0, slot, release, deadline) of all blocks in the order of slots; blocks: source -> number of them."""
    yield from _Earliest(_parts({s: weights[s] for s in blocks})).run(blocks)


def temperature(counts: dict, power: float = 0.5) -> dict:
    """Target weights by the source's documents to a power below 1: small sources come earlier than their size asks for."""
    return {s: n**power for s, n in counts.items()}


_OWN = ("block", "slot", "release", "deadline", "position")


def _planned(spark: SparkSession, weights: dict, counts: dict, block: int, columns: list[str]) -> DataFrame:
    """plan() as rows (source, block, slot, release, deadline, documents of the blocks before), named as told."""
    schema = pa.schema([(c, pa.int64() if i else pa.string()) for i, c in enumerate(columns)])
    kinds = ", ".join(f"`{c}` {'long' if i else 'string'}" for i, c in enumerate(columns))
    rows, start, path = [], 0, None

    def frame() -> DataFrame:
        return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema), kinds) if rows else spark.createDataFrame([], kinds)

    for s, j, *when in plan(weights, {s: -(-n // block) for s, n in counts.items()}):
        if len(rows) == CHUNK:
            path = path or shared_path(spark, "mixing")
            frame().write.mode("append").parquet(path)
            rows = []
        rows.append((s, j, *when, start))
        start += min(block, counts[s] - block * j)
    last = frame()
    return spark.read.schema(kinds).parquet(path).unionAll(last) if path else F.broadcast(last)


def mix(docs: DataFrame, weights: dict | None = None, block: int = 16, power: float = 0.5) -> DataFrame:
    """docs with their place in the mixture: block (of the source, from 0), slot, release, deadline (in slots), position (from 0, without gaps).

    docs: doc_id, source and any columns but those five, which are replaced. A null source is a source of its own; a null doc_id counts as
    the empty string in the digest; ties in the digest are ordered by doc_id, and rows that tie in both take neighbouring places in any order.
    weights: of the sources, above 0, by default by temperature(); sources without one are given the least weight. No documents: no rows.
    """
    names = [c for c in docs.columns if c.lower() not in _OWN]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    src, digest, run, rank, n, before, part, start = fresh(docs, "_src", "_digest", "_run", "_rank", "_n", "_before", "_block", "_start")
    docs = docs.withColumns({src: F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")), digest: F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))})
    docs = docs.withColumn(run, F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("int"))
    runs = docs.groupBy(src, run).agg(F.count("*").alias(n))
    counts = {r[0]: r[1] for r in runs.groupBy(src).agg(F.sum(n)).collect()}
    if weights is None:
        weights = temperature(counts, power)
    else:
        given = {"n" if s is None else f"s{s}": w for s, w in weights.items()}
        weights = {s: given.get(s, min(given.values())) for s in counts}
    # rank within a run, plus the documents of the runs before: no task sees a whole source
    above = Window.partitionBy(src).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(src, run, F.coalesce(F.sum(n).over(above), F.lit(0)).alias(before))
    own = Window.partitionBy(src, run).orderBy(digest, "doc_id")
    ranked = docs.withColumn(rank, F.row_number().over(own) - 1).join(offsets, [src, run])
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(before)).withColumn(part, F.floor(F.col(rank) / block))
    # a plan of more than a chunk is in the shared folder and isn't broadcast
    placed = ranked.join(_planned(docs.sparkSession, weights, counts, block, [src, part, "slot", "release", "deadline", start]), [src, part])
    return placed.select(*(F.col(f"`{c}`") for c in names), F.col(part).alias("block"), "slot", "release", "deadline", (F.col(start) + F.col(rank) - F.col(part) * block).alias("position"))


def ordered(docs: DataFrame, **options) -> DataFrame:
    """docs, the same columns, in mixed order. Options are those of mix()."""
    place, *own = fresh(docs, "_position", *(f"_own_{i}" for i in range(len(docs.columns))))
    names = docs.columns
    # columns that mix() would replace travel under other names
    kept = {c: o for c, o in zip(names, own) if c.lower() in _OWN}
    mixed = mix(docs.withColumnsRenamed(kept), **options).withColumnRenamed("position", place)
    return mixed.orderBy(place).select(*(F.col(f"`{kept.get(c, c)}`").alias(c) for c in names))


#: The same in DuckDB's SQL, from a table documents, with mix()'s defaults: weights are square roots, exact in units of 2 ** -52.
SQL = """
WITH RECURSIVE src AS (SELECT coalesce('s' || source, 'n') AS s, count(*) AS docs, (pow(count(*)::DOUBLE, 0.5) * 4503599627370496)::HUGEINT AS c FROM documents GROUP BY 1),
tot AS (SELECT sum(c)::HUGEINT AS t FROM src),
plan AS (
  SELECT 0::HUGEINT AS slot, NULL::STRUCT(deadline HUGEINT, s VARCHAR, j HUGEINT, release HUGEINT) AS pick, 0::HUGEINT AS place, list(struct_pack(s := s, c := c, n := ((docs + 15) // 16)::HUGEINT, j := 0::HUGEINT)) AS st FROM src
  UNION ALL
  SELECT place + 1, pick, place, list_transform(st, lambda x: struct_pack(s := x.s, c := x.c, n := x.n, j := x.j + (CASE WHEN x.s = pick.s THEN 1 ELSE 0 END)::HUGEINT))
  FROM (SELECT st, place, list_sort(list_filter(cand, lambda x: x.release <= place))[1] AS pick
    FROM (SELECT st, cand, greatest(slot, list_min(list_transform(cand, lambda x: x.release))) AS place
      FROM (SELECT slot, st, list_transform(list_filter(st, lambda x: x.j < x.n), lambda x: struct_pack(deadline := ((x.j + 1) * t + x.c - 1) // x.c, s := x.s, j := x.j, release := (x.j * t) // x.c)) AS cand FROM plan, tot) AS a
      WHERE len(cand) > 0) AS b) AS d
),
blocks AS (SELECT pick.s AS s, pick.j::BIGINT AS block, place::BIGINT AS slot, pick.release::BIGINT AS release, pick.deadline::BIGINT AS deadline, least(16, docs - 16 * pick.j)::BIGINT AS size FROM plan JOIN src ON src.s = pick.s WHERE pick IS NOT NULL),
starts AS (SELECT *, sum(size) OVER (ORDER BY slot) - size AS start FROM blocks),
ranked AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS s, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS r FROM documents)
SELECT doc_id, source, block, slot, release, deadline, (start + r - 16 * block)::BIGINT AS position FROM ranked JOIN starts ON starts.s = ranked.s AND block = r // 16
"""

"""Harmonic packing of token sequences.

A piece of length n belongs to class k = capacity // n, the reciprocal-capacity class (capacity / (k + 1), capacity / k], and
a bin of class k takes exactly k pieces of that class, whatever they are. So a worker fills its bins without knowing of others.
Documents may be cut: a remainder that would leave more than `slack` of its class's bin empty gives up its largest reciprocal
part capacity // (k + 1) and goes on with what is left, but no cut leaves a piece below `floor` ids. Bins that a worker can't fill hand their pieces to further rounds,
each over groups of 8 of the groups before (more, if there were over 7 rounds otherwise), until one group is left: less than one bin a class comes from each group, so what a task sees depends on the number of classes and not
on the documents. What is left in the end is packed by decreasing length.

pack_in_order() keeps an order: consecutive places form windows, each packed by itself, and sequences are numbered by window and within it by their first piece.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import materialize, trimmed
from tesserae.llm.tokens import default_path, encoder

_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long"
_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in _COLUMNS.split(", ")])


@functools.lru_cache(maxsize=1 << 16)
def cut(n: int, capacity: int, slack: float, floor: int = 1) -> tuple[int, ...]:
    """Lengths of the pieces of n ids, in order; all but full ones are shorter than the capacity. What is left after the full ones is cut into no piece below floor ids."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        part = capacity // (k + 1)
        if k * n >= (1 - slack) * capacity or part == 0:
            return (*out, n)
        if part < floor or n - part < floor:
            # the smallest piece that may be left, if the rest then fills its bins better than the whole
            first = n - floor
            return (*out, first, floor) if first >= floor and capacity // first * first > k * n else (*out, n)
        out.append(part)
        n -= part
    return tuple(out)


class _Bins:
    """The open bins of one worker by class, and the rows of those that are full."""

    def __init__(self, capacity: int, prefix: int):
        self._capacity, self._next = capacity, prefix
        self._open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for p in pieces:
            self.rows.append((*p[:5], self._next, at, p[7]))
            at += p[2]
        self._next += 1

    def add(self, piece: tuple) -> None:
        k = self._capacity // piece[2]
        pieces = self._open.setdefault(k, [])
        pieces.append(piece)
        if len(pieces) == k:
            del self._open[k]
            self.close(pieces)

    def rest(self) -> list[tuple]:
        return [p for k in sorted(self._open) for p in self._open[k]]

    def flush(self, size: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= size and self.rows:
            yield _batch(self.rows)
            self.rows = []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 8, schema=_SCHEMA)


def _best_fit(rest: list[tuple], capacity: int) -> list[list[tuple]]:
    """Pieces in bins by decreasing length. room: (free, bin) in ascending order."""
    room: list[tuple[int, int]] = []
    packed: list[list[tuple]] = []
    for p in sorted(rest, key=lambda p: -p[2]):
        i = bisect.bisect_left(room, (p[2], -1))
        free, b = room.pop(i) if i < len(room) else (capacity, len(packed))
        if b == len(packed):
            packed.append([])
        packed[b].append(p)
        if free > p[2]:
            bisect.insort(room, (free - p[2], b))
    return packed


def _rounds(level: int, bits: int | None, capacity: int):
    """Of a later round: the rows of one group in, packed rows out. bits: of the partition's number that a group leaves out; None in the last."""

    def pack(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(c.to_pylist() for c in table.select(_SCHEMA.names).columns)), key=lambda r: tuple((x is not None, x) for x in r))
        group = rows[0][7] >> bits if bits else 0
        bins = _Bins(capacity, level << 60 | group << 32)
        for r in rows:
            bins.add(r)
        rest = bins.rest()
        if bits:
            bins.rows += rest
        else:
            for pieces in _best_fit(rest, capacity):
                bins.close(pieces)
        return pa.Table.from_batches([_batch(bins.rows)])

    return pack


#: Ids of the smallest piece that a cut may leave.
FLOOR = 64


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 2, slack: float = 0.01, tokenizer: str | None = None, floor: int = FLOOR) -> DataFrame:
    """Pack the token ids of every text into sequences of at most `capacity` ids.

    docs: doc_id (any integer, null and repeated ids allowed: every row is packed by itself) and text (null as empty); other
    columns are ignored. A document's ids are its text's by the tokenizer, then end_id, so an empty text still has one piece.
    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id (unique, not dense), offset. No rows
    for no documents. Padding a sequence to `capacity`, or leaving it at a power of two, is up to the writer.
    """
    path = tokenizer or default_path()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        bins, tok = _Bins(capacity, part << 32), encoder(path)
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for lo, _, flat, offs in tok.encode_column(batch.column(1), end_id):
                flat = np.ascontiguousarray(flat, "<u4")
                bounds = offs.tolist()
                for i in range(len(bounds) - 1):
                    a, n = bounds[i], bounds[i + 1] - bounds[i]
                    start = 0
                    for size in cut(n, capacity, slack, floor):
                        bins.add((ids_of[lo + i], start, size, zlib.crc32(flat[a + start : a + start + size]), n, None, None, part))
                        start += size
            yield from bins.flush(20_000)
        bins.rows += bins.rest()
        yield from bins.flush(0)

    first = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(local), _COLUMNS), "packing")
    rounds, rest = [first], first
    most = rest.agg(F.max("part")).first()[0] or 0
    by = max(3, -(-most.bit_length() // 6))
    for level, bits in enumerate([*range(by, most.bit_length(), by), None], 1):
        group = F.shiftright("part", bits) if bits else F.lit(0)
        rest = rest.where("sequence_id is null").groupBy(group.alias("g")).applyInArrow(_rounds(level, bits, capacity), _COLUMNS)
        rest = materialize(rest, "packing") if bits else rest
        rounds.append(rest)
    return functools.reduce(DataFrame.unionAll, [r.where("sequence_id is not null") for r in rounds]).drop("part")


_CUT = "array<struct<start: long, length: long, crc: long, tokens: long>>"


def pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 2, slack: float = 0.01, tokenizer: str | None = None, floor: int = FLOOR) -> DataFrame:
    """Of each row of docs (doc_id, source, text) its doc_id, source and `pieces`, as pack() cuts them; no text or ids, so that it can be put in order at little cost."""
    path = tokenizer or default_path()
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "crc", "tokens")]))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path)
        for batch in batches:
            for lo, _, flat, offs in tok.encode_column(batch.column(2), end_id, 1 << 20):
                flat = np.ascontiguousarray(flat, "<u4")
                bounds, out = offs.tolist(), []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    start, own = 0, []
                    for size in cut(b - a, capacity, slack, floor):
                        own.append({"start": start, "length": size, "crc": zlib.crc32(flat[a + start : a + start + size]), "tokens": b - a})
                        start += size
                    out.append(own)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(out)), batch.column(1).slice(lo, len(out)), pa.array(out, kind)], names=["doc_id", "source", "pieces"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return materialize(rows.mapInArrow(trimmed(local), f"doc_id long, source string, pieces {_CUT}"), "packing")


def pack_in_order(placed: DataFrame, capacity: int = 4096, window: int = 2048) -> DataFrame:
    """pack()'s columns, with sequences that follow an order. placed: pieces() with `position`, places from 0 without gaps.

    Of the documents at places w * window and on, `window` in number, the sequences are w << 32 and on, in the order of their first pieces: those below
    w << 32 hold the documents before place w * window, and no others. A window's last sequences are filled from it alone.
    """

    def fill(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(c.to_pylist() for c in table.select(["position", "start", "doc_id", "length", "crc", "tokens"]).columns)), key=lambda r: r[:2])
        bins = _Bins(capacity, 0)
        for position, start, doc, length, crc, tokens in rows:
            bins.add((doc, start, length, crc, tokens, None, None, position))
        for group in _best_fit(bins.rest(), capacity):
            bins.close(group)
        first: dict[int, tuple] = {}
        for r in bins.rows:
            first[r[5]] = min(first.get(r[5], (r[7], r[1])), (r[7], r[1]))
        number = {s: i for i, s in enumerate(sorted(first, key=first.get))}
        base = rows[0][0] // window << 32
        return pa.Table.from_batches([_batch([(*r[:5], base + number[r[5]], *r[6:]) for r in bins.rows])])

    flat = placed.select("doc_id", "position", F.inline("pieces"))
    return flat.groupBy(F.floor(F.col("position") / window).alias("g")).applyInArrow(fill, _COLUMNS).drop("part")

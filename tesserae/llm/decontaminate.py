"""Passages of benchmark items found in documents.

The benchmark's texts are normalised (A-Z lower-cased, one space between words) and cut into windows of some words, which go into one Aho-Corasick automaton; a space at both ends of a window makes matches whole words.
Every document is normalised alike and scanned once; matches become places of words, and these become offsets in the original text. The automaton is broadcast as the pieces of text that it is built from. A benchmark beyond
PIECE_BYTES makes several broadcasts of about that size, and a task then holds one automaton after the other while its batches of documents wait.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tesserae.llm.common import byte_words, steps

SIZE = 10
#: Bytes of normalised text that one automaton is made of, about; it takes some 450 times as much.
PIECE_BYTES = 1 << 19
#: Words of an item that stay together; neighbouring pieces share the words that windows need.
PIECE_WORDS = 2048
#: Bytes of text that are scanned before the next automaton is loaded, where there are several.
SCANNED = 1 << 25

#: 0-9, A-Z, a-z and everything beyond ASCII belong to words.
words_of = byte_words(lambda b: b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _pieces(size: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """item, piece: normalised runs of at most PIECE_WORDS windows."""
        for batch in batches:
            items, out = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of((text or "").encode())
                for a in range(0, max(1, len(words) - size + 1) if words else 0, PIECE_WORDS):
                    items.append(item)
                    out.append(b" ".join(words[a : a + PIECE_WORDS + size - 1]))
            yield pa.record_batch([pa.array(items, pa.string()), pa.array(out, pa.binary()).cast(pa.string())], ["item", "piece"])

    return go


def build(pieces: list[tuple[str | None, str]], size: int) -> tuple[ahocorasick.Automaton, list[list]]:
    """The automaton of all windows, each with its number of words and the place of its items in the list that comes with it."""
    owners: dict[str, set] = {}
    for item, piece in pieces:
        words = piece.encode().decode("latin-1").split(" ")
        for a in range(max(1, len(words) - size + 1)):
            owners.setdefault(" ".join(words[a : a + size]), set()).add(item)
    automaton, lists, places = ahocorasick.Automaton(), [], {}
    for window, items in owners.items():
        key = frozenset(items)
        if key not in places:
            places[key] = len(lists)
            lists.append([i for i in key if i is not None])
        automaton.add_word(f" {window} ", (window.count(" ") + 1, places[key]))
    if owners:
        automaton.make_automaton()
    return automaton, lists


def occurrences(words: list[bytes], automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """First word, number of words and list of items of every place where a window stands."""
    if not len(automaton):
        return []
    found = list(automaton.iter(f" {b' '.join(words).decode('latin-1')} "))
    if not found:
        return []
    ends = list(accumulate(len(w) + 1 for w in words))  # of the space after each word
    at = np.searchsorted(ends, [end for end, _ in found])
    return [(int(w) - n + 1, n, k) for w, (_, (n, k)) in zip(at, found)]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of hit words."""
    edges = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - 1).tolist()))


def _offsets(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    wanted = {w for run in runs for w in run}
    at = {i: (m.start(), m.end()) for i, m in enumerate(_WORD.finditer(text)) if i in wanted}
    return [{"start": at[a][0], "end": at[b][1]} for a, b in runs]


def _scan(shards: list, size: int, names: list[str], text_at: int):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = build(shards[0].value, size) if len(shards) == 1 else None

        def automata() -> Iterator[tuple]:
            if only is not None:
                yield only
                return
            for s in shards:  # one at a time
                yield build(s.value, size)

        def scanned(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = [b.column(text_at).to_pylist() for b in held]
            state: dict[tuple[int, int], tuple[np.ndarray, set]] = {}
            counts = [[0] * len(t) for t in texts]
            for k, (automaton, lists) in enumerate(automata()):
                for i, own in enumerate(texts):
                    for j, text in enumerate(own):
                        words = words_of((text or "").encode())
                        counts[i][j] = len(words)
                        if found := occurrences(words, automaton):
                            if (i, j) not in state:
                                state[i, j] = (np.zeros(len(words), bool), set())
                            hit, items = state[i, j]
                            edges = np.zeros(len(words) + 1, np.int64)
                            np.add.at(edges, [a for a, _, _ in found], 1)
                            np.add.at(edges, [a + n for a, n, _ in found], -1)
                            hit |= np.cumsum(edges[:-1]) > 0
                            for place in {x[2] for x in found}:
                                items.update(lists[place])
            for i, batch in enumerate(held):
                rows = [state.get((i, j)) for j in range(batch.num_rows)]
                more = [
                    pa.array(counts[i], pa.int64()),
                    pa.array([int(r[0].sum()) if r else 0 for r in rows], pa.int64()),
                    pa.array([sorted(r[1]) if r else [] for r in rows], pa.list_(pa.string())),
                    pa.array([_offsets(texts[i][j], _runs(r[0])) if r else [] for j, r in enumerate(rows)], spans_type),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

        held, size_held = [], 0
        for batch in batches:
            held.append(batch)
            size_held += batch.column(text_at).nbytes
            if only is not None or size_held >= SCANNED:
                yield from scanned(held)
                held, size_held = [], 0
        if held:
            yield from scanned(held)

    return go


NEW = ("n_words", "n_hit", "items", "spans")


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, text: str = "text", item: str = "item_id", item_text: str = "text", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence of a window), items (ids, as strings in order, of items with an occurring window) and spans (start and end, in characters of the original text, of each run of hit words).

    A window is `size` consecutive words of an item; an item of fewer, but not none, is one window. Null texts have no words; an item with a null id marks words, but isn't named; rows of one item id are one item. An empty
    benchmark finds nothing. Repeated documents are scanned each by itself. Columns of docs that are called like a new one are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*NEW)
    with steps(spark) as step:
        pieces = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).mapInArrow(_pieces(size), "item string, piece string").distinct()
        pieces = step(pieces, "decontaminate-pieces")
        total = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
        n = max(1, math.ceil(total / piece_bytes))
        shard = F.pmod(F.xxhash64("item", "piece"), F.lit(n))
        shards = [spark.sparkContext.broadcast([(r.item, r.piece) for r in pieces.where(shard == k).collect()]) for k in range(n)]
    added = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType())), StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])))]
    schema = StructType([*docs.schema.fields, *added])
    return docs.mapInArrow(_scan(shards, size, schema.names, docs.columns.index(text)), schema)


def without(docs: DataFrame, text: str = "text") -> DataFrame:
    """scan()'s rows with the hit passages cut out of the text; spans, items and counts stay as they were."""
    pieces = F.concat(
        F.transform(F.col("spans"), lambda s, i: F.substring(F.col(text), F.when(i == 0, 0).otherwise(F.get("spans", i - 1)["end"]).cast("int") + 1, (s["start"] - F.when(i == 0, 0).otherwise(F.get("spans", i - 1)["end"])).cast("int"))),
        F.array(F.expr(f"substring(`{text}`, cast(spans[size(spans) - 1].end as int) + 1)")),
    )
    return docs.withColumn(text, F.when(F.size("spans") > 0, F.array_join(pieces, "")).otherwise(F.col(text)))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    got = scan(docs.select("doc_id", "text"), benchmark)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _sql(size: int = SIZE) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
items AS (SELECT item_id, {words} AS w FROM benchmark),
windows AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), {size}) AS size, array_to_string(w[i : i + least(len(w), {size}) - 1], ' ') AS gram FROM items, LATERAL unnest(range(1, greatest(len(w) - {size}, 0) + 2)) u(i) WHERE len(w) > 0),
grams AS (SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram FROM docs, (SELECT DISTINCT size FROM windows), LATERAL unnest(range(1, len(w) - size + 2)) u(i) WHERE len(w) >= size),
found AS MATERIALIZED (SELECT r, i, size, item_id FROM grams JOIN windows USING (size, gram)),
hits AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, i, size FROM found), LATERAL unnest(range(i, i + size)) u(j) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""


SQL = _sql()

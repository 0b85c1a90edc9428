"""How far the sources of a language stand apart in their words.

One pass over the texts counts terms by language and source within each task, so that a frequent term of a hot source is one row of a task. The counts are dealt out by language and term, which settles at once in how
many documents a term stands, and so the kept terms. These are cut into chunks by a hash of the term, and sources into blocks; a task gets one chunk of terms for two blocks of sources. There the chunk's terms, sorted by
their UTF-8 bytes, are its dictionary: terms become their places by searchsorted, counts become dense vectors by bincount, and differences of shares are sums over these vectors. Places keep the order of the terms, so
ties among the best terms fall to the smaller place. All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import byte_words, materialize

MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Terms that a task counts before it hands its counts on.
HELD = 1 << 19
#: Cells of a chunk, its terms times its sources, and the least number of its terms; sources of a block.
CELLS, LEAST, BLOCK = 1 << 16, 1024, 512
#: Languages that are broadcast, of some 60 bytes; more are joined by shuffles.
FEW = 200_000
#: Stands before the source in the row that shows a group to be there; no term has it.
GROUP = "\0"

#: A-Z, a-z and everything beyond ASCII belong to terms.
terms_of = byte_words(lambda b: b >= 128 or 65 <= b <= 90 or 97 <= b <= 122)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, d for the rows of each language, source and text."""
    n, d, held = {}, {}, 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), c in n.items():
            words, own = list(c), d[lang, source]
            for a in range(0, len(words), 1 << 15):
                part = words[a : a + (1 << 15)]
                size = len(part)
                yield pa.record_batch([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([c[w] for w in part], pa.int64()), pa.array([own[w] for w in part], pa.int64())], ["lang", "source", "term", "n", "d"])
        n.clear()
        d.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            key = (lang, source)
            if key not in n:
                n[key], d[key] = Counter(), Counter()
                marker = (GROUP + source).encode()
                n[key][marker] = d[key][marker] = 0
                held += 1
            words = terms_of(text.as_py().encode())
            before = len(n[key])
            n[key].update(words)
            d[key].update(set(words))
            held += len(n[key]) - before
            if held >= HELD:
                yield from flush()
                held = 0
    yield from flush()


def share(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), by long division in steps of 1000, exact for totals below 2^53."""
    rest, whole, out = count + 2, total + 2 * kept, 0
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


_SCHEMA = "lang string, part string, source string, item string, v long, present long, absent long, kept long"


def _chunk(top: int):
    def go(rows: pa.Table) -> pa.Table:
        """One chunk of terms for two blocks of sources, a and b, or for the one block twice."""
        lang, kept, lang_total = rows["lang"][0].as_py(), rows["kept"][0].as_py(), rows["lang_total"][0].as_py()
        a, b = rows["a"][0].as_py(), rows["b"][0].as_py()
        is_group = pc.is_null(rows["term"])
        groups, counts = rows.filter(is_group), rows.filter(pc.invert(is_group))
        sources, block, totals = groups["source"].to_pylist(), np.array(groups["block"]), np.array(groups["n"], np.int64)
        coded = counts["term"].combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        found = np.empty(len(coded.dictionary), object)
        found[:] = [w.encode() for w in coded.dictionary.to_pylist()]
        dictionary = np.sort(found)
        ids = np.searchsorted(dictionary, found)[np.array(coded.indices, np.int64)] if len(found) else np.zeros(0, np.int64)
        size, width = len(sources), len(dictionary)
        at = np.array(pc.index_in(counts["source"], value_set=pa.array(sources, pa.string())), np.int64)
        held = np.bincount(at * width + ids, weights=np.array(counts["n"], np.int64), minlength=size * width).astype(np.int64).reshape(size, width)
        of_lang = np.zeros(width, np.int64)
        of_lang[ids] = np.array(counts["lang_n"], np.int64)
        out = {k: [] for k in ("part", "source", "item", "v", "present", "absent")}

        def add(*row) -> None:
            for k, v in zip(out, row):
                out[k].append(v)

        if kept:
            p, zero = share(held, totals[:, None], kept), share(np.zeros(size, np.int64), totals, kept)
        else:
            p, zero = held, np.ones(size, np.int64)
        for i in range(size):
            others = np.flatnonzero((block == b) if a != b else (np.arange(size) > i)) if a == b or block[i] == a else []
            if len(others):
                sums = apart(p[i], p[others]).sum(axis=1) if width else np.zeros(len(others), np.int64)
                for j, v, z in zip(others.tolist(), sums.tolist(), apart(zero[i], zero[others]).tolist()):
                    add("pair", sources[i], sources[j], v, width, z)
                    add("pair", sources[j], sources[i], v, width, z)
        if a == b and width:
            q = share(of_lang, np.int64(lang_total), kept)
            value = apart(p, q)
            for i in range(size):
                good = np.flatnonzero((held[i] > 0) & (p[i] > q))
                for j in good[np.lexsort((good, -value[i][good]))[:top]].tolist():
                    add("term", sources[i], dictionary[j].decode(), int(value[i][j]), 0, 0)
        rows_out = len(out["part"])
        return pa.table({"lang": pa.array([lang] * rows_out, pa.string()), **{k: pa.array(v, pa.string() if k in ("part", "source", "item") else pa.int64()) for k, v in out.items()}, "kept": pa.array([kept] * rows_out, pa.int64())})

    return go


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for every language and source, how far each other source of the language stands from it (part pair), and its `top` most typical terms against the language (part term).

    Null text, lang and source are read as ''. Every row is a document, repeated ones too. Sources without terms, and languages without kept terms, have pairs of their own, in the latter case of value 0; a language of one
    source has none. An empty table gives no rows. Columns other than text, lang and source aren't read. Counts must stay below 2^53.
    """
    spark = docs.sparkSession
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = read.mapInArrow(_count, "lang string, source string, term string, n long, d long")
    counts = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    by_term = Window.partitionBy("lang", "term")
    is_group = F.col("term").startswith(GROUP)
    known = counts.select("lang", "source", "term", "n", F.sum("d").over(by_term).alias("_d"), F.sum("n").over(by_term).alias("lang_n"), (F.row_number().over(by_term.orderBy("source")) == 1).alias("first"))
    known = materialize(known.where((F.col("_d") >= min_docs) | is_group).drop("_d"), "divergence")
    langs = known.groupBy("lang").agg(F.count_if(F.col("first") & ~is_group).alias("kept"), F.sum("n").alias("lang_total"), F.count_if(is_group).alias("_sources"))
    langs = langs.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("kept") / F.greatest(F.lit(LEAST), F.floor(F.lit(CELLS) / F.col("_sources")))))).withColumn("blocks", F.ceil(F.col("_sources") / BLOCK)).drop("_sources")
    langs = F.broadcast(langs) if langs.limit(FEW + 1).count() <= FEW else langs
    block = F.pmod(F.xxhash64(F.lit(3), "source"), "blocks").alias("block")
    shown = ["lang", "kept", "lang_total", "blocks", "source", block, "n"]
    groups = known.groupBy("lang", "source").agg(F.sum("n").alias("n")).join(langs, "lang").select(*shown, F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("lang_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    cells = known.where(~is_group).join(langs, "lang").select(*shown, "term", "lang_n", F.pmod(F.xxhash64(F.lit(5), "term"), "chunks").alias("chunk"))
    dealt = groups.unionByName(cells).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("a", F.least("block", "_other")).withColumn("b", F.greatest("block", "_other")).drop("_other", "blocks")
    made = dealt.groupBy("lang", "chunk", "a", "b").applyInArrow(_chunk(top), _SCHEMA)
    value = F.sum("v") + F.when(F.col("part") == "pair", F.max("absent") * (F.max("kept") - F.sum("present"))).otherwise(0)
    summed = made.groupBy("lang", "source", "part", "item").agg(value.cast("long").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def _sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
words AS MATERIALIZED (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(words) AS term FROM docs) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS lang_n FROM words GROUP BY ALL HAVING count(*) >= {MIN_DOCS}),
langs AS MATERIALIZED (SELECT lang, count(term) AS v, coalesce(sum(lang_n), 0) AS total FROM (SELECT DISTINCT lang FROM groups) LEFT JOIN kept USING (lang) GROUP BY lang),
counts AS MATERIALIZED (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM words GROUP BY ALL) c USING (lang, source, term)),
shares AS MATERIALIZED (SELECT lang, source, term, n, 1 + ({UNIT} * (n + 2)) // ((sum(n) OVER (PARTITION BY lang, source)) + 2 * v) AS p, 1 + ({UNIT} * (lang_n + 2)) // (total + 2 * v) AS q FROM counts JOIN langs USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(p.value, 0) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= {TOP}"""


SQL = _sql()

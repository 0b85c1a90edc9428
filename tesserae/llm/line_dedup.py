"""Lines that stand in many documents, dropped everywhere. DataFrame functions only.

Texts are split once: every line with a key becomes a row of its document, place and hash, and these rows, which hold no text, are made durable. Hashes are counted with
map-side sums; of those in enough rows the distinct documents are counted exactly, which deals a frequent hash out by its documents. The rows whose hash goes are found again by these few hashes, each
document gets its list of places that go, and its lines are joined by position without them. Two 64-bit hashes stand for a key, 128 bits in all.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import fresh, materialize, steps

SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, with A-Z lower-cased."""
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.btrim(F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, string.ascii_uppercase, string.ascii_lowercase)), F.lit(SPACE))


def _hash(line: Column) -> Column:
    """Null for a line without a key."""
    key = line_key(line)
    return F.when(F.length(key) > 0, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b")))


#: Hashes that are broadcast, of 16 bytes; more are joined by shuffles.
FEW = 200_000


def _among(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows whose key is among `keys`."""
    few = keys.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(keys) if few else keys, name, "left_semi")


def dedup(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """docs with text replaced by what is left, and n_lines and n_dropped.

    docs: doc_id and text (null or empty: one empty line), and any other columns but n_lines and n_dropped, which are replaced; columns of docs keep
    their places. A document is a doc_id: its rows count once for a key, and rows with a null doc_id don't count; what goes goes from every row. No rows: no rows.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    lines, one, two, gone, doc, key, place, kept = fresh(docs, "_lines", "_one", "_two", "_gone", "_doc", "_key", "_place", "_kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # rows of one doc_id with one text lose the same places, so these three tell rows apart
    docs = docs.withColumns({one: F.xxhash64(text), two: F.xxhash64(F.lit(7), text)})
    keys = docs.select(F.col("doc_id").alias(doc), one, two, F.posexplode(F.transform(F.split(text, "\n", -1), _hash)).alias(place, key))
    with steps(docs.sparkSession) as step:
        keys = step(keys.where(F.col(key).isNotNull()), "lines")
        often = keys.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select(key)
        found = step(_among(keys, step(often, "often"), key), "found")
        step.drop(keys)
        common = found.select(key, doc).distinct().groupBy(key).agg(F.count(doc).alias("n")).where(F.col("n") >= min_docs).select(key)
        places = _among(found, step(common, "common"), key).groupBy(doc, one, two).agg(F.collect_set(place).alias(gone))
        # the only table that the result is read from
        places = materialize(places, "places")
    places = places.withColumnsRenamed({one: f"{one}_of", two: f"{two}_of"})
    joined = docs.join(places, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(one) == F.col(f"{one}_of")) & (F.col(two) == F.col(f"{two}_of")), "left")
    joined = joined.withColumn(lines, F.split(text, "\n", -1))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.col(lines)[i])
    out = joined.withColumn(kept, F.when(F.col(gone).isNull(), text).otherwise(F.array_join(left, "\n")))
    columns = [F.col(kept).alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in names]
    return out.select(*columns, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))


def digest(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    return dedup(docs.select("doc_id", "text"), min_docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The same in DuckDB's SQL, from a table documents.
SQL = r"""
WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) > 0 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT doc_id, pos, line, k IN (SELECT k FROM common) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

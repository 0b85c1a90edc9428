"""SimHash fingerprints, and search by permuted block tables.

The distinct words of a text, A-Z lower-cased, vote with weight 1 + ln(times) on each of 128 signed sums by the bits of their hash; the signs
are the fingerprint. Of m blocks of fingerprints within `radius` bits of each other one differs in `flips` bits at most, if (flips + 1) * m > radius; so a table for
each block, keyed by it and asked for all keys within `flips` bits of the query's, finds every fingerprint in the radius, and the Hamming distance decides.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import textvec
from tesserae.llm.common import materialize, steps, trimmed

BITS = 128
#: Bits in which texts differ whose words were replaced down to a 5-shingle similarity of 0.8: on 89 texts of the tables, 14 takes in 95 to 100 % by length, 3 takes in 0 to 29 %.
RADIUS = 14

ALIKE = 256
#: A key of a query, which is made, shuffled and looked up, costs as much as so many meetings, which are compared where they are found.
KEY = 10
#: Smaller numbers of fingerprints are laid out like this one, so that work grows evenly with them.
LEAST = 1 << 16
#: Blocks that are broadcast, of some 20 bytes.
FEW = 200_000


def fingerprints(buf: np.ndarray, offs: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Rows of 16 bytes; all zero for a text without words."""
    buf = textvec.LOWER[buf]
    start, end, first = textvec.spans(buf, offs, textvec.NON_SPACE)
    n = len(offs) - 1
    out = np.zeros((n, BITS // 8), np.uint8)
    if not len(start):
        return out
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    # 40 bits tell apart the words of a text
    key = np.sort(doc << np.uint64(40) | textvec.Hasher(buf)(start, end) >> np.uint64(24))
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    weight = np.rint(64 * (1 + np.log(np.diff(np.append(head, len(key)))))).astype(np.int32)
    key = key[head]
    of = (key >> np.uint64(40)).astype(np.int64)
    word = key & np.uint64((1 << 40) - 1)
    terms = np.stack([textvec.mix(word), textvec.mix(word ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
    begin = np.searchsorted(of, np.arange(n + 1))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + step, "right")) - 1)
        a, b = begin[lo], begin[hi]
        if b > a:
            bits = np.unpackbits(terms[a:b].view(np.uint8), axis=1)
            w = weight[a:b, None]
            full = np.flatnonzero(begin[lo + 1 : hi + 1] > begin[lo:hi])
            at = begin[lo:hi][full] - a
            votes = 2 * np.add.reduceat(bits * w, at, axis=0) - np.add.reduceat(w, at, axis=0)
            out[lo + full] = np.packbits(votes > 0, axis=1)
        lo = hi
    return out


def _column(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, BITS // 8), np.uint8), *(fingerprints(b, o) for _, _, b, o in textvec.chunks(texts))])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits of fingerprints, row by row."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def edit(text: str, following: str) -> str:
    """The last quarter of the text, in whole code points, replaced by as many of the following text's first."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, ahead, doc_id, text) in order: each real row against the next of its bucket, of which an `ahead` row may be the last."""
    held: list[tuple] = []
    for rows in _slices(batches):
        rows = held + rows
        if len(rows) > 1:
            yield from _rows(rows, last=False)
        held = rows[-1:]
    if held:
        yield from _rows(held, last=True)


def _slices(batches: Iterator[pa.RecordBatch], limit: int = 1 << 22) -> Iterator[list[tuple]]:
    for batch in batches:
        size, out = 0, []
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            r = (r[0], r[1], r[2], r[3] or "")
            out.append(r)
            size += len(r[3])
            if size >= limit:
                yield out
                size, out = 0, []
        if out:
            yield out


def _rows(rows: list[tuple], last: bool) -> Iterator[pa.RecordBatch]:
    """A row is compared with the one after it; the last one only at the end of the partition, then with itself."""
    pairs = [(i, i + 1 if i + 1 < len(rows) and rows[i + 1][0] == rows[i][0] else i) for i in range(len(rows) if last else len(rows) - 1) if not rows[i][1]]
    if not pairs:
        return
    own = _column(pa.array([r[3] for r in rows], pa.large_string()))
    edited = [edit(rows[i][3], rows[j][3]) for i, j in pairs]
    changed = _column(pa.array(edited, pa.large_string()))
    i, j = np.array(pairs).T
    yield pa.RecordBatch.from_arrays([
        pa.array([rows[k][2] for k in i], pa.int64()), pa.array([len(rows[k][3]) for k in i], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array([f.tobytes().hex() for f in own[i]]), pa.array([f.tobytes().hex() for f in changed]), pa.array(likeness(own[i], changed)), pa.array(likeness(own[i], own[j])),
    ], schema=_SCHEMA)


def compare(docs: DataFrame, buckets_per_partition: int = 4) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    docs: doc_id and text (null as empty); other columns are ignored. Order: doc_id, null ids first, then text. Ids are dealt to buckets by
    quantiles, and the first document of each bucket goes to the bucket before too, so that no document needs more than its bucket.
    The last document's next is the first; a lone document's next is itself.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = n * buckets_per_partition
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # of the rows with a null id the first by text comes after the last document
    first = F.min_by(F.md5(F.coalesce("text", F.lit(""))), F.when(F.col("doc_id").isNull(), F.struct(F.col("text").isNotNull().alias("a"), F.col("text").alias("b"))))
    got = rows.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)], 10 * count).alias("at"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), first.alias("first")).first()
    bounds = np.array(sorted({*(got["at"] or [])} - {got["least"]}), np.int64)
    least, nulls, first = got["least"], got["nulls"], got["first"]

    @F.pandas_udf("struct<bucket: int, begins: boolean>")
    def place(ids: pd.Series) -> pd.DataFrame:
        x = ids.to_numpy(np.int64)
        bucket = np.searchsorted(bounds, x, "right")
        begins = (bucket > 0) & (bounds[np.maximum(bucket - 1, 0)] == x) if len(bounds) else np.zeros(len(x), bool)
        return pd.DataFrame({"bucket": bucket.astype(np.int32), "begins": begins})

    # null ids are in the first bucket, as is whatever stands for them here
    at = rows.withColumn("at", place(F.coalesce("doc_id", F.lit(least if least is not None else 0))))
    null = F.col("doc_id").isNull()
    leads = null & (F.md5(F.coalesce("text", F.lit(""))) == first) if nulls else F.col("doc_id") == least
    own = F.struct(F.col("at.bucket").alias("bucket"), F.lit(False).alias("ahead"))
    more = F.when(leads, F.struct(F.lit(len(bounds)).cast("int").alias("bucket"), F.lit(True).alias("ahead"))).when(~null & F.col("at.begins"), F.struct((F.col("at.bucket") - 1).alias("bucket"), F.lit(True).alias("ahead")))
    dealt = at.select(F.inline(F.array_compact(F.array(own, more))), "doc_id", "text")
    ordered = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "ahead", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    return ordered.mapInArrow(trimmed(_compare), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def layout(radius: int, n: int) -> tuple[int, list[tuple[int, int]]]:
    """How many bits a query's key may differ in, and the blocks as runs of hexadecimal digits, for n fingerprints: with m blocks one of them differs in `flips` bits at most if (flips + 1) * m > radius.

    Few flips mean few keys for a query but short blocks, which many unrelated fingerprints share; of all choices the one whose keys and meetings cost least together, so that blocks get longer with the logarithm of n.
    Texts of a language have common words, so unrelated fingerprints meet about ALIKE times as often as random ones.
    """
    digits, best, n = BITS // 4, None, max(n, LEAST)
    for flips in range(radius + 1):
        m = radius // (flips + 1) + 1
        if m > digits:
            continue
        cuts = [(i * digits // m, (i + 1) * digits // m) for i in range(m)]
        keys = [sum(math.comb(4 * (b - a), k) for k in range(flips + 1)) for a, b in cuts]
        cost = sum(k * (KEY + ALIKE * n / 16 ** (b - a)) for k, (a, b) in zip(keys, cuts))
        if best is None or cost < best[0]:
            best = cost, flips, cuts
    return best[1], best[2]


def _half(name: str, at: int):
    return F.conv(F.substring(name, at, 16), 16, -10).cast("long")


def _whole(name: str):
    return F.lower(F.concat(*(F.lpad(F.hex(f"{name}_{at}"), 16, "0") for at in (1, 17))))


def _masks(spark: SparkSession, flips: int, cuts: list[tuple[int, int]]) -> DataFrame:
    """The keys of a query: its block in each table with up to `flips` bits turned. As many as the radius makes them, whatever the data."""
    masks = [(t, sum(1 << i for i in at)) for t, (a, b) in enumerate(cuts) for k in range(flips + 1) for at in itertools.combinations(range(4 * (b - a)), k)]
    return F.broadcast(spark.createDataFrame([(t, x - (1 << 64) if x >> 63 else x) for t, x in masks], "table int, mask long"))


def _blocks(name: str, cuts: list[tuple[int, int]]):
    return F.array(*(F.conv(F.substring(name, a + 1, b - a), 16, -10).cast("long") for a, b in cuts))


def _gap(a: str, b: str):
    """Bits in which two fingerprints differ, each as two longs."""
    return F.bit_count(F.col(f"{a}_1").bitwiseXOR(F.col(f"{b}_1"))) + F.bit_count(F.col(f"{a}_17").bitwiseXOR(F.col(f"{b}_17")))


def within(queries: DataFrame, prints: DataFrame, radius: int = 3) -> DataFrame:
    """(query, fingerprint, distance) of all distinct fingerprints within the radius of each distinct query, itself included: as many rows as there are such pairs. For numbers of neighbours see neighbours().

    Both have a column fingerprint, 32 hexadecimal digits; null is ignored.
    """
    known = prints.select("fingerprint").where("fingerprint is not null").distinct()
    flips, cuts = layout(radius, known.count())

    def tables(df: DataFrame, name: str) -> DataFrame:
        df = df.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        return df.select(*(_half(name, at).alias(f"{name}_{at}") for at in (1, 17)), _blocks(name, cuts).alias(f"{name}_blocks"), F.posexplode(_blocks(name, cuts)).alias("table", "block"))

    asked = tables(queries, "query").join(_masks(queries.sparkSession, flips, cuts), "table").withColumn("block", F.col("block").bitwiseXOR(F.col("mask"))).drop("mask")
    pairs = asked.join(tables(known, "fingerprint"), ["table", "block"])
    # a pair counts in the first table that it meets in
    for t in range(len(cuts)):
        pairs = pairs.where((F.col("table") <= t) | (F.bit_count(F.col("query_blocks")[t].bitwiseXOR(F.col("fingerprint_blocks")[t])) > flips))
    return pairs.where(_gap("query", "fingerprint") <= radius).select(_whole("query").alias("query"), _whole("fingerprint").alias("fingerprint"), _gap("query", "fingerprint").alias("distance")).distinct()


#: Fingerprints of one block from which on they are a class.
CROWD = 16


def neighbours(queries: DataFrame, prints: DataFrame, radius: int, crowd: int = CROWD) -> DataFrame:
    """(query, n): how many documents have a fingerprint within the radius of each distinct query's, itself included. queries: fingerprint; prints: fingerprint, n (its documents), a row for each fingerprint.

    Fingerprints that share a block with `crowd` others form a class by the first such block, with the majority of their bits as its centre; each other one is a class by itself. Tables hold classes, so a group of near copies
    is met once by a query, however large it is. By the triangle inequality a class's fingerprints at distance r from the centre are all within the radius of a query at distance d from it if d + r is, and none if |d - r| is
    not; their numbers by r are counted beforehand, and only those in between are compared one by one.
    """
    spark = prints.sparkSession
    with steps(spark) as step:
        known = prints.where("fingerprint is not null")
        flips, cuts = layout(radius, known.count())
        rows = step(known.select(_half("fingerprint", 1).alias("x_1"), _half("fingerprint", 17).alias("x_17"), "n", _blocks("fingerprint", cuts).alias("blocks")), "prints")
        keys = rows.select("x_1", "x_17", F.posexplode("blocks").alias("table", "block"))
        full = keys.groupBy("table", "block").agg(F.count("*").alias("_n")).where(F.col("_n") >= crowd).drop("_n")
        full = F.broadcast(full) if full.limit(FEW + 1).count() <= FEW else full
        # the class of a crowd is its block, in the form of a number
        first = keys.join(full, ["table", "block"]).groupBy("x_1", "x_17").agg(F.min_by(F.xxhash64("table", "block"), F.struct("table", "block")).alias("class"))
        placed = step(rows.join(first, ["x_1", "x_17"], "left").withColumn("crowd", F.col("class").isNotNull()).withColumn("class", F.coalesce("class", F.xxhash64(F.lit("alone"), "x_1", "x_17"))), "placed")

        def majority(half: int):
            bits = [F.when(2 * F.sum(F.shiftrightunsigned(f"x_{half}", b).bitwiseAND(F.lit(1))) > F.count("*"), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)]
            return functools.reduce(lambda a, b: a.bitwiseOR(b), bits).alias(f"c_{half}")

        centres = placed.where("crowd").groupBy("class").agg(majority(1), majority(17))
        centres = step(centres.unionByName(placed.where("not crowd").select("class", F.col("x_1").alias("c_1"), F.col("x_17").alias("c_17"))).dropDuplicates(["class"]), "centres")
        members = step(placed.join(centres, "class").withColumn("r", _gap("x", "c")).select("class", "crowd", "r", "x_1", "x_17", "n", "blocks"), "members")
        # a fingerprint by itself goes with its keys, so that it is compared where a query meets it
        lone = [F.when(~F.col("crowd"), F.col(f"x_{at}")).alias(f"e_{at}") for at in (1, 17)]
        entries = members.select("class", *lone, F.posexplode("blocks").alias("table", "block")).distinct()
        # queries are dealt before their keys are made: there are many of them to each
        dealt = queries.select("fingerprint").where("fingerprint is not null").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fingerprint").distinct()
        asked = dealt.select(_half("fingerprint", 1).alias("q_1"), _half("fingerprint", 17).alias("q_17"), F.posexplode(_blocks("fingerprint", cuts)).alias("table", "block"))
        asked = asked.join(_masks(spark, flips, cuts), "table").withColumn("block", F.col("block").bitwiseXOR(F.col("mask"))).drop("mask")
        met = asked.join(entries, ["table", "block"]).where(F.col("e_1").isNull() | (_gap("q", "e") <= radius)).select("q_1", "q_17", "class").distinct()
        met = met.join(centres, "class").select("q_1", "q_17", "class", _gap("q", "c").alias("d"))
        shells = members.groupBy("class", "r").agg(F.sum("n").alias("n"))
        near = step(met.join(shells, "class").where(F.abs(F.col("d") - F.col("r")) <= radius), "shells")
        sure = near.where(F.col("d") + F.col("r") <= radius).select("q_1", "q_17", "n")
        open_ = near.where(F.col("d") + F.col("r") > radius).drop("n").join(members, ["class", "r"]).where(_gap("q", "x") <= radius).select("q_1", "q_17", "n")
        summed = sure.unionAll(open_).groupBy("q_1", "q_17").agg(F.sum("n").alias("n"))
        return materialize(summed.select(_whole("q").alias("query"), "n"), "neighbours")


def report(docs: DataFrame, radius: int = 3, every: int = 50) -> DataFrame:
    """compare(), and n_within: of each document whose id is divisible by `every`, how many others lie within the radius (else null)."""
    got = materialize(compare(docs), "simhash")
    asked = got.where(F.col("doc_id") % every == 0)
    size = got.groupBy("fingerprint").agg(F.count("*").alias("n"))
    near = neighbours(asked, size, radius).select("query", (F.col("n") - 1).alias("n_within"))
    found = asked.select("doc_id", "fingerprint").join(near, F.col("fingerprint") == F.col("query")).groupBy("doc_id").agg(F.max("n_within").alias("n_within"))
    return got.join(found, "doc_id", "left")

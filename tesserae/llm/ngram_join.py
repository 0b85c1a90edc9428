"""Self-join of documents on the Jaccard similarity of their word shingles, exact, by token-combination prefixes.

Tokens are 64-bit hashes of shingles, in three tiers by the documents that have them: rare ones are indexed singly, frequent ones as pairs, and very frequent ones as triples. Frequent
tokens are dealt to classes by hash, and combinations are formed within a class, so that they stay in proportion to tokens. The global order has the rare tokens first, each
tier by hash. If two sets share at least o tokens, the prefix of either must hold a shared one for as long as it has more than |x| - o tokens; where a class is indexed
by k-combinations it takes k - 1 tokens more of that class. So a document's prefix is extended until what its classes give, rare tokens plus each class's tokens less k - 1,
exceeds |x| - o. Documents of fewer than `short` tokens, whose prefixes hold no class, are indexed singly. Sizes fall into regimes; near a border a document is indexed in both.

Candidates are not all pairs of a bucket. Each bucket has a few hubs, members that share the most signatures with others; each other member is held against these by
bitmaps (parities of hashed tokens, of which sets that differ in d tokens differ in d bits at most), and what may link is joined to clusters. Then members of different clusters are
held against each other in the same way, if their shared prefix tokens leave a similarity of the threshold possible, and clusters that may link become one. So every link lies within a
cluster, and up to here no set was moved.

The different sets of a cluster form blocks of bounded size, each pair of blocks whose sizes can link is a cell, and in it all overlaps are found as products of 0/1 matrices: how many
documents each set links with, and which sets are connected. Numbers leave a cell, not pairs; connections of cells are joined to components. Most clusters are one cell. The work of larger ones grows with the square
of their sets, as their links do; where links needn't be counted, these are verified by hubs and cross pairs alone, which grows with their members.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import textvec
from tesserae.llm.common import Steps, materialize, release, steps, trimmed
from tesserae.llm.components import components

#: Similarity NUM / DEN.
NUM, DEN = 80, 100
SHINGLE = 5
#: Tokens of the smallest sets that are indexed by combinations, and classes of a tier at that size.
SHORT, CLASSES = 16, 2


def least_overlap(n: int) -> int:
    """Tokens that a set of n shares with any set that it links to."""
    return -(-NUM * n // DEN)


def regimes(n: int) -> list[int]:
    """0: below SHORT; r: SHORT * 4 ** (r - 1) and up to four times that; and the one before, for sizes that a smaller partner may come from."""
    r = 0
    while n >= SHORT * 4**r:
        r += 1
    return [r - 1, r] if r and NUM * n < DEN * SHORT * 4 ** (r - 1) else [r]


@functools.lru_cache(maxsize=1 << 10)
def _combinations(size: int, k: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(size), k)), np.int64).reshape(-1, k)


def signatures(h: np.ndarray, frequent: np.ndarray, very: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """Hashes under which a set is indexed, odd for combinations and even for single tokens, and whether combinations are among them. h: ascending; frequent, very: by token, very frequent ones being frequent."""
    n = len(h)
    need = n - least_overlap(n) + 1
    very = np.zeros(n, bool) if very is None else very
    rare, often = h[~frequent], np.concatenate([h[frequent & ~very], h[very]])
    k = np.repeat([2, 3], [int((frequent & ~very).sum()), int(very.sum())])
    out, combined = [], False
    for r in regimes(n):
        salt = textvec.mix(np.array([r + 1], np.uint64))
        single = rare[:need]
        if r == 0:
            single = np.concatenate([rare, often])[:need]
        elif len(rare) < need:
            combined = True
            classes = CLASSES * 4 ** (r - 1)
            of = ((often >> np.uint64(7)) % np.uint64(classes)).astype(np.int64) + (k - 2) * classes
            order = np.argsort(of, kind="stable")
            begin = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]]))
            place = np.empty(len(often), np.int64)
            place[order] = np.arange(len(often)) - np.repeat(begin, np.diff(np.append(begin, len(often))))
            last = int(np.searchsorted(np.cumsum(place >= k - 1), need - len(rare))) + 1
            order = order[order < last]
            part, of = often[order], of[order]
            begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            count = np.diff(np.append(begin, len(of)))
            for size, times in np.unique(np.stack([count, of[begin] // classes + 2]), axis=1).T.tolist():
                rows = part[begin[(count == size) & (of[begin] // classes + 2 == times)][:, None] + np.arange(size)]
                some, value = _combinations(size, times), np.uint64(0)
                for j in range(times):
                    value = value * np.uint64(0xC2B2AE3D27D4EB4F) + rows[:, some[:, j]]
                out.append(textvec.mix(textvec.mix(value).reshape(-1) ^ salt) | np.uint64(1))
        out.append(textvec.mix(single ^ salt) & ~np.uint64(1))
    return np.concatenate(out), combined


def largest_partner(n: int, frequent: int) -> int:
    """The size up to which a set of n tokens can link with one that shares none of its rare tokens: all that they share are among its frequent ones."""
    return frequent * (NUM + DEN) // NUM - n


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """doc_ids, distinct shingles and their offsets, in chunks."""
    for batch in batches:
        for lo, hi, buf, offs in textvec.chunks(batch.column(1)):
            yield batch.column(0).slice(lo, hi - lo), *textvec.shingle_sets(buf, offs, SHINGLE)


#: Longs of a document's bitmap.
WORDS = 16


def bitmaps(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of WORDS longs: each bit is the parity of a set's tokens that fall on it. Sets that differ in d tokens differ in at most d bits."""
    docs = np.repeat(np.arange(len(at) - 1), np.diff(at))
    count = np.bincount(docs * 64 * WORDS + (h & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=(len(at) - 1) * 64 * WORDS)
    return np.packbits((count & 1).astype(np.uint8).reshape(-1, 64 * WORDS), axis=1).view(np.int64)


_PROFILE = "doc_id long, n long, digest binary, token long, times long, bits array<long>"


def _profile(often: float, flush: int = 1 << 22):
    """Rows of documents (size, digest, bitmap) and rows of tokens that may be frequent, with the numbers of different sets of the task that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size, docs = set(), [], 0, 0
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("token", pa.int64()), ("times", pa.int64()), ("bits", pa.list_(pa.int64()))])

        def tokens() -> Iterator[pa.RecordBatch]:
            if held:
                t, times = np.unique(np.concatenate(held), return_counts=True)
                keep = times >= max(2, often * docs)
                t, times = t[keep].view(np.int64), times[keep]
                none = [pa.nulls(len(t), f.type) for f in list(schema)[:3]]
                yield pa.RecordBatch.from_arrays([*none, pa.array(t), pa.array(times), pa.nulls(len(t), pa.list_(pa.int64()))], schema=schema)

        for ids, h, at in _sets(batches):
            rows, bits = [], pa.ListArray.from_arrays(np.arange(0, len(at) * WORDS, WORDS, dtype=np.int32), bitmaps(h, at).reshape(-1))
            for doc, a, b in zip(ids.to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                if doc is None or a == b:
                    rows.append((doc, b - a, None))
                    continue
                digest = _digest(h[a:b])
                rows.append((doc, b - a, digest))
                if digest not in seen:
                    seen.add(digest)
                    held.append(h[a:b])
                    size, docs = size + b - a, docs + 1
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), bits], schema=schema)
            if size >= flush:
                yield from tokens()
                held, size, docs = [], 0, 0
        yield from tokens()

    return run


_POSTINGS = "part int, nodes binary, sizes binary, limits binary, counts binary, signatures binary"


def _postings(shared, parts: int, flush: int = 1 << 20):
    """Signatures of the marked documents, by part of the hash range: documents, their sizes and largest partners without a rare token in common, signatures of each. shared: frequent tokens, whether they are very frequent,
    marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, often, marks = shared.value
        sieve = np.zeros(1 << 22, bool)
        sieve[frequent >> np.uint64(42)] = True
        held: list[tuple[int, int, np.ndarray, int]] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            sig, n = np.concatenate([x[2] for x in held]), np.array([len(x[2]) for x in held])
            of = np.repeat(np.arange(len(held)), n)
            part = ((sig >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            sig, of = sig[order], of[order]
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            node, sizes, limits = (np.array([x[i] for x in held], "<i8") for i in (0, 1, 3))
            out = []
            for p in range(parts):
                a, b = ends[p], ends[p + 1]
                if b > a:
                    docs, counts = np.unique(of[a:b], return_counts=True)
                    out.append((p, node[docs].tobytes(), sizes[docs].tobytes(), limits[docs].tobytes(), counts.astype("<u4").tobytes(), sig[a:b].tobytes()))
            for lo in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(zip(*out[lo : lo + 64]))], names=["part", "nodes", "sizes", "limits", "counts", "signatures"])

        for ids, h, at in _sets(_marked(batches, marks)):
            hit = sieve[h >> np.uint64(42)]
            very = np.zeros(len(h), bool)
            if hit.any():
                t = h[hit]
                i = np.minimum(np.searchsorted(frequent, t), len(frequent) - 1)
                found = frequent[i] == t
                very[hit] = found & often[i]
                hit[hit] = found
            for doc, a, b in zip(ids.to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                if doc is None or a == b:
                    continue
                sig, _ = signatures(h[a:b], hit[a:b], very[a:b])
                held.append((doc, b - a, sig, largest_partner(b - a, int(hit[a:b].sum()))))
                size += len(sig)
            if size >= flush:
                yield from rows()
                held, size = [], 0
        yield from rows()

    return run


_BUCKETS = "bucket long, times int, node long, n long, most long, combined boolean"


def _buckets(table: pa.Table) -> pa.Table:
    """Of one part of the hash range the signatures that several documents have. Signatures with the same documents count as one bucket, `times` over; it is combined if all of them are of combinations. most: the document's largest
    partner without a rare token in common."""
    read = {c: [np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("nodes", "<i8"), ("sizes", "<i8"), ("limits", "<i8"), ("counts", "<u4"), ("signatures", "<u8"))}
    cat = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in read.items()}
    sig = cat["signatures"].astype(np.uint64)
    of = np.repeat(np.arange(len(cat["nodes"])), cat["counts"])
    order = np.argsort(sig, kind="stable")
    sig, of = sig[order], of[order]
    same = sig[1:] == sig[:-1]
    many = np.zeros(len(sig), bool)
    many[1:] = same
    many[:-1] |= same
    sig, of = sig[many], of[many]
    kinds = {"bucket": pa.int64(), "times": pa.int32(), "node": pa.int64(), "n": pa.int64(), "most": pa.int64(), "combined": pa.bool_()}
    if not len(sig):
        return pa.table({n: pa.array([], t) for n, t in kinds.items()})
    node = cat["nodes"][of]
    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    count = np.diff(np.append(begin, len(sig)))
    whole = textvec.mix(np.add.reduceat(textvec.mix(node.astype(np.uint64)), begin) ^ count.astype(np.uint64))
    whole, first, back, times = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    combined = np.ones(len(whole), bool)
    np.logical_and.at(combined, back, (sig[begin] & np.uint64(1)).astype(bool))
    count = count[first]
    rows = np.repeat(begin[first] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    of = of[rows]
    return pa.table({"bucket": np.repeat(whole, count).view(np.int64), "times": np.repeat(times, count).astype(np.int32), "node": cat["nodes"][of], "n": cat["sizes"][of], "most": cat["limits"][of], "combined": np.repeat(combined, count)})


#: Slots of the bitmap of wanted documents.
SLOTS = 1 << 25


def _marks(ids: DataFrame) -> np.ndarray:
    """Bytes of a bitmap with a bit for each id modulo SLOTS: 4 MB at most, whatever the ids' number; where slots are shared it lets more through."""
    slot = F.pmod("doc_id", F.lit(SLOTS)) + 1
    parts = ids.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in parts:
        out[(r.part - 1) * 4096 :][: len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def _marked(batches: Iterator[pa.RecordBatch], marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows whose first column's slot is marked."""
    for batch in batches:
        slot = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False) % SLOTS
        hit = (marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
        yield batch.filter(pa.array(hit.astype(bool)).cast(pa.bool_()))


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _tokens(shared):
    """Sets of the documents whose slot is marked, and their digests: texts are read where they lie and not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h, at in _sets(_marked(batches, shared.value)):
            sets = [h[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            columns = [pa.array([f(x) for x in sets], pa.binary()) for f in (np.ndarray.tobytes, _digest)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["id", "tokens", "digest"])

    return run


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: sets are long."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sets those that link."""
    for batch in _slices(batches):
        u, v, left, right = (c.to_pylist() for c in batch.columns)
        keep = []
        for i, (a, b) in enumerate(zip(left, right)):
            n = (len(a) + len(b)) // 8
            both = np.sort(np.concatenate([np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")]))
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            if DEN * shared >= NUM * (n - shared):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in keep], pa.int64()) for c in (u, v)], names=["u", "v"])


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, tokens, digest) of the documents of these ids, and by chance of a few more; a document may have several texts."""
    shared = docs.sparkSession.sparkContext.broadcast(_marks(ids))
    return docs.mapInArrow(trimmed(_tokens(shared)), "id long, tokens binary, digest binary")


def _verify(pairs: DataFrame, docs: DataFrame, step: Steps) -> DataFrame:
    """(u, v) of the pairs that link. v: the side of fewer documents."""
    pairs = step(pairs, "pairs")
    sets = step(_sets_of(pairs.select(F.col("u").alias("doc_id")).unionAll(pairs.select(F.col("v").alias("doc_id"))).distinct(), docs), "sets")
    few = sets.join(pairs.select(F.col("v").alias("id")).distinct(), "id", "left_semi")
    left = pairs.join(sets.select(F.col("id").alias("u"), F.col("tokens").alias("a")), "u")
    both = left.join(few.select(F.col("id").alias("v"), F.col("tokens").alias("b")), "v").select("u", "v", "a", "b")
    found = step(both.mapInArrow(trimmed(_linked), "u long, v long").distinct(), "links")
    step.drop(pairs, sets)
    release(docs.sparkSession)
    return found


def _near(a: str, b: str):
    """Whether sets of such sizes can link."""
    return (F.col(a) * DEN >= F.col(b) * NUM) & (F.col(b) * DEN >= F.col(a) * NUM)


def _apart(a: str, b: str):
    """Bits in which bitmaps differ."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(WORDS)), F.lit(0))


def _alike(n_a: str, bits_a: str, n_b: str, bits_b: str):
    """Whether the bitmaps leave the overlap possible that the threshold asks for: n_a + n_b - 2 * overlap tokens may differ."""
    size = F.col(n_a) + F.col(n_b)
    return _apart(bits_a, bits_b) <= size - 2 * F.ceil(size * NUM / (NUM + DEN))


def _possible(a: str, b: str, shared):
    """Whether so many shared signatures leave the overlap possible that the threshold asks for.

    Of a set's prefix, whose classes give one token more than |x| less its least overlap, the o tokens that a pair must share leave out |x| - o at most. Each shared token adds a shared signature but
    for the k - 1 of a class that the prefix was extended by: so o less the least overlap, plus one, must be shared, by that of the two whose prefix ends first.
    """
    after = F.greatest(*(F.ceil(F.col(c) * NUM / DEN) - 1 for c in (a, b)))
    return shared + after >= F.ceil((F.col(a) + F.col(b)) * NUM / (NUM + DEN))


#: Sets and tokens of a block, and the columns of a matrix.
BLOCK, BLOCK_TOKENS, WIDTH = 512, 1 << 20, 4096


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Tokens that each set of the left shares with each of the right."""
    tokens = [np.concatenate(x) for x in (left, right)]
    common = np.intersect1d(*tokens)
    out = np.zeros((len(left), len(right)))
    hits = []
    for side, t in zip((left, right), tokens):
        of, at = np.repeat(np.arange(len(side)), [len(x) for x in side]), np.searchsorted(common, t)
        hit = common[np.minimum(at, len(common) - 1)] == t if len(common) else np.zeros(len(t), bool)
        order = np.argsort(at[hit], kind="stable")
        hits.append((of[hit][order], at[hit][order]))
    for lo in range(0, len(common), WIDTH):
        width, tiles = min(WIDTH, len(common) - lo), []
        for side, (of, at) in zip((left, right), hits):
            a, b = np.searchsorted(at, [lo, lo + width])
            tiles.append(np.zeros((len(side), width), np.float32))
            tiles[-1][of[a:b], at[a:b] - lo] = 1
        out += tiles[0] @ tiles[1].T
    return out.astype(np.int64)


_FOUND = "digest binary, linked long, first long, least long"


def _connected(linked: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Of the sets on either side (right: None, if it is the same) the smallest number that links reach."""
    both, top = left.copy(), np.iinfo(np.int64).max
    other = both if right is None else right.copy()
    while True:
        new = np.minimum(both, np.where(linked, other, top).min(axis=1, initial=top))
        far = new if right is None else np.minimum(other, np.where(linked.T, new, top).min(axis=1, initial=top))
        if (new == both).all() and (far == other).all():
            return new, far
        both, other = new, far


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, right, digest, first, n_copies, tokens) ordered by cell: of each set that links across the cell how many documents it links with, and the smallest document that links reach within the
    cell. A cell of one side is compared with itself."""

    def cell(rows: list[tuple]) -> Iterator[tuple]:
        rows = list({(r[1], r[2]): r for r in rows}.values())
        sides = [[r for r in rows if r[1] == side] for side in (False, True)]
        own = not sides[1]
        left, right = sides[0], sides[0] if own else sides[1]
        if not left or len(rows) < 2:
            return
        sets = [[np.frombuffer(r[5], "<u8") for r in x] for x in ((left,) if own else (left, right))]
        shared = overlaps(sets[0], sets[-1])
        size = np.array([len(x) for x in sets[0]])[:, None] + np.array([len(x) for x in sets[-1]])
        linked = DEN * shared >= NUM * (size - shared)
        if own:
            np.fill_diagonal(linked, False)
        first = [np.array([r[3] for r in x], np.int64) for x in (left, right)]
        least = _connected(linked, first[0], None if own else first[1])
        for x, least_x, times in zip((left, right), least, (linked @ np.array([r[4] for r in right], np.int64), None if own else linked.T @ np.array([r[4] for r in left], np.int64))):
            if times is not None:
                yield from ((r[2], n, r[3], m) for r, n, m in zip(x, times.tolist(), least_x.tolist()) if n)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i else pa.binary()) for i in range(4)], names=_FOUND.replace(",", "").split()[::2])

    held: list[tuple] = []
    for b in _slices(batches):
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[0][0] != row[0]:
                out += cell(held)
                held = []
            held.append(row)
        if out:
            yield batch(out)
    if held:
        yield batch(list(cell(held)))


#: Rows that are broadcast, of about 100 bytes.
FEW = 100_000


def _cells(own: DataFrame, docs: DataFrame, step: Steps) -> DataFrame:
    """(digest, linked, first, least) of the sets that link, a row for each cell. own: digest, first, n, n_copies, component, kind of the sets of clusters."""
    blocks = own.groupBy("component", "kind").agg(F.count("*").alias("sets"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    at = own.join(blocks.drop("sets"), ["component", "kind"]).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")).drop("blocks")
    at = at.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("other", F.col("kind") + F.col("step"))
    at = at.join(blocks.withColumnRenamed("kind", "other"), ["component", "other"]).where("step <> 0 or sets > 1")
    at = at.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = (F.col("step") < 0) | ((F.col("step") == 0) & (F.col("block") > F.col("to")))
    ends = [F.when(right, F.col(b)).otherwise(F.col(a)) for a, b in (("kind", "other"), ("block", "to"), ("other", "kind"), ("to", "block"))]
    cells = step(at.select(F.concat_ws("-", "component", *ends).alias("cell"), right.alias("right"), "digest", "first", "n_copies"), "cells")
    sets = _sets_of(cells.select(F.col("first").alias("doc_id")).distinct(), docs).withColumnRenamed("id", "first")
    few = cells.limit(FEW + 1).count() <= FEW
    work = sets.join(F.broadcast(cells) if few else cells, ["first", "digest"]).select("cell", "right", "digest", "first", "n_copies", "tokens")
    found = step(work.repartition("cell").sortWithinPartitions("cell").mapInArrow(trimmed(_counted), _FOUND), "counts")
    release(docs.sparkSession)
    return found


#: Hubs of a bucket.
HUBS = 3


def _stars(buckets: DataFrame, bits: DataFrame) -> DataFrame:
    """(u, v, apart, hub): members of a bucket with those of its hubs that they may link with by their bitmaps, the share of bits in which they differ, and whether u is a hub too. Hubs are those that share
    the most signatures, and two drawn from those that share nearly as many; in overlapping buckets they are mostly the same. bits: node, n, bits."""
    weight = buckets.groupBy("node").agg(F.sum("times").alias("weight"))
    member = buckets.join(weight, "node")
    nearly = F.floor(F.log2("weight") * 4)
    best = [F.max(F.struct(F.when(F.lit(i == 0), F.col("weight")).otherwise(nearly).alias("w"), F.xxhash64(F.lit(i), "node").alias("h"), F.col("node").alias("hub"), F.col("n").alias("hub_n"))).alias(f"h{i}") for i in range(HUBS)]
    hubs = member.groupBy("bucket").agg(*best).select("bucket", F.explode(F.array_distinct(F.array(*(F.struct(f"h{i}.hub", f"h{i}.hub_n") for i in range(HUBS))))).alias("hub")).select("bucket", "hub.*")
    # what is shared in other buckets than the hub's isn't counted here, so as much again is allowed for; the exact test is left to the members of different clusters
    pairs = buckets.join(hubs, "bucket").where("node <> hub").where(_near("n", "hub_n")).groupBy("node", "hub", "n", "hub_n").agg(F.sum("times").alias("shared"))
    pairs = pairs.where(_possible("n", "hub_n", 2 * F.col("shared"))).select("node", "hub").distinct()
    every = hubs.select("hub").distinct()
    x, y = (bits.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("node", "hub"))
    pairs = pairs.join(y.join(every, "hub", "left_semi"), "hub").join(x, "node").where(_alike("n_node", "bits_node", "n_hub", "bits_hub"))
    pairs = pairs.select("node", "hub", (_apart("bits_node", "bits_hub") / (F.col("n_node") + F.col("n_hub"))).alias("apart"))
    pairs = pairs.join(every.select(F.col("hub").alias("node"), F.lit(True).alias("_hub")), "node", "left")
    return pairs.select(F.col("node").alias("u"), F.col("hub").alias("v"), "apart", F.coalesce("_hub", F.lit(False)).alias("hub"))


#: Members from which on a bucket is divided by sizes, and the factor between neighbouring cells of sizes.
LARGE, RATIO = 1024, 1.12


def _meetings(member: DataFrame) -> DataFrame:
    """Pairs of members of one bucket in different components, columns with _a and _b, whose sizes can link, and which can link without a rare token in common if the bucket is a large one of combinations.

    Sets that share a rare token meet in its bucket; what others share are frequent tokens only, so for either of them the other one has at most `most` tokens. In a large bucket of combinations a member meets only members of
    sizes that it can link with: those of one passage that is too small a part of them meet nobody, however many they are.
    """

    def cell(size):
        return F.floor(F.ln(size) / math.log(RATIO)).cast("int")

    divided = F.col("combined") & F.col("large")
    low, high = cell(F.ceil(F.col("n") * NUM / DEN)), cell(F.least(F.floor(F.col("n") * DEN / NUM), F.col("most")))
    cells = F.when(~divided, F.array(F.lit(-1))).when(F.col("most") * DEN >= F.col("n") * NUM, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    names = ("node", "n", "most", "component", "hidden", "bits")
    a = member.withColumn("_cell", F.explode(cells)).select("bucket", "times", divided.alias("_divided"), "_cell", *(F.col(c).alias(f"{c}_a") for c in names))
    b = member.select(F.col("bucket").alias("_bucket"), F.when(divided, cell(F.col("n"))).otherwise(-1).alias("_own"), *(F.col(c).alias(f"{c}_b") for c in names))
    alone = (F.col("n_a") <= F.col("most_b")) & (F.col("n_b") <= F.col("most_a"))
    return a.join(b, (F.col("bucket") == F.col("_bucket")) & (F.col("_cell") == F.col("_own")) & (F.col("component_a") < F.col("component_b")) & _near("n_a", "n_b") & (~F.col("_divided") | alone))


def _cross(buckets: DataFrame, bits: DataFrame, label: DataFrame, step: Steps) -> DataFrame:
    """(u, v) of the members of one bucket in different components that may link by shared prefix tokens and bitmaps. label: node, component."""
    member = buckets.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = member.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), (F.count("*") >= LARGE).alias("large")).where("lo <> hi").drop("lo", "hi")
    member = member.join(mixed, "bucket").groupBy("bucket", "node", "n", "component", "large").agg(F.sum("times").alias("times"), F.max("most").alias("most"), F.bool_and("combined").alias("combined"))
    # what a member shares in divided buckets isn't all seen
    hidden = F.sum(F.when(F.col("large") & F.col("combined"), F.col("times")).otherwise(0)).over(Window.partitionBy("node", "n")).alias("hidden")
    member = step(member.select("*", hidden).join(bits, ["node", "n"]), "mixed")
    pairs = _meetings(member).where(_alike("n_a", "bits_a", "n_b", "bits_b"))
    alone = (F.col("n_b") <= F.col("most_a")) & (F.col("n_a") <= F.col("most_b"))
    pairs = pairs.groupBy("node_a", "node_b", "n_a", "n_b").agg(F.sum("times").alias("shared"), F.max(F.when(alone, 0).otherwise(F.least("hidden_a", "hidden_b"))).alias("unseen"))
    pairs = pairs.where(_possible("n_a", "n_b", F.col("shared") + F.col("unseen"))).select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))
    pairs = step(pairs.distinct(), "pairs")
    step.drop(member)
    return pairs


def _by_hubs(nodes: DataFrame, star: DataFrame, buckets: DataFrame, bits: DataFrame, docs: DataFrame, step: Steps) -> DataFrame:
    """(u, v): links that connect the nodes as all their links do. Each is verified with its likeliest hub, hubs with each other, and then members of different components."""
    star = star.join(nodes.select(F.col("node").alias("u")), "u", "left_semi")
    likeliest = star.groupBy("u").agg(F.min_by("v", F.struct("apart", "v")).alias("v"))
    links = _verify(likeliest.unionAll(star.where("hub").select("u", "v")).distinct(), docs, step)
    label = components(links, step=step)
    pairs = _cross(buckets.join(nodes, "node", "left_semi"), bits, label, step)
    return links.unionAll(_verify(pairs, docs, step))


def _labelled(docs: DataFrame, step: Steps, counts: bool = True, often: float = 1 / 8000, least_often: int = 16, very: float = 1 / 400, per_part: int = 1_000_000) -> tuple[DataFrame, ...]:
    """doc_id, n, digest of every document; node and component of those that link; digest, first document, n, n_copies of every set; digest, linked (with counts: documents of other sets that it links with)."""
    spark = docs.sparkSession
    profile = step(docs.mapInArrow(trimmed(_profile(often)), _PROFILE), "profile")
    rows = profile.where("times is null").select("doc_id", "n", "digest")
    own = rows.where("digest is not null")
    groups = step(own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.count("*").alias("n_copies")), "groups")
    total = groups.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).first()
    bound = max(least_often, often * total.docs)
    times = profile.where("times is not null").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= bound)
    found = times.select("token", (F.col("times") >= max(bound, very * total.docs)).alias("very")).toArrow()
    frequent = np.asarray(found.column(0).to_numpy(), np.int64).view(np.uint64)
    order = np.argsort(frequent)
    marks = _marks(groups.select(F.col("first").alias("doc_id")))
    shared = spark.sparkContext.broadcast((frequent[order], np.asarray(found.column(1).to_numpy(zero_copy_only=False), bool)[order], marks))
    parts = max(8, -(-int((total.tokens or 0) * (DEN - NUM) / DEN + total.docs) // per_part))
    postings = docs.mapInArrow(trimmed(_postings(shared, parts)), _POSTINGS)
    buckets = step(postings.groupBy("part").applyInArrow(_buckets, _BUCKETS), "buckets")
    release(spark)

    bits = profile.where("digest is not null").select(F.col("doc_id").alias("node"), "n", "bits")
    bits = step(bits.join(buckets.select("node").distinct(), "node", "left_semi").distinct(), "bits")
    star = step(_stars(buckets, bits), "pairs")
    near = components(star.select("u", "v"), step=step)
    cross = _cross(buckets, bits, near, step)
    # clusters of candidates, also where a document isn't the first of its set
    same = step(own.join(groups.select("digest", "first"), "digest").where("doc_id <> first").select(F.col("doc_id").alias("u"), F.col("first").alias("v")), "same")
    edges = near.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(cross)
    touched = edges.select("u").union(edges.select("v")).distinct()
    cluster = components(edges.unionAll(same.join(touched, "u", "left_semi")), step=step)
    held = groups.join(cluster, F.col("first") == F.col("node")).drop("node")
    whole = held.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("all")).where("sets > 1")
    # sizes that link differ by a factor of DEN / NUM at most: by less than one kind
    kind = F.when((F.col("sets") <= BLOCK) & (F.col("all") <= BLOCK_TOKENS), 0).otherwise(F.floor(F.ln("n") / math.log(1.04 * DEN / NUM)) + 1).cast("int")
    held = step(held.join(whole, "component").withColumn("kind", kind).drop("sets", "all"), "members")
    found = _cells(held if counts else held.where("kind = 0"), docs, step)
    links = found.where("first <> least").select(F.col("first").alias("u"), F.col("least").alias("v"))
    if not counts and not held.where("kind > 0").isEmpty():
        nodes = step(cluster.join(held.where("kind > 0").select("component").distinct(), "component", "left_semi").select("node"), "nodes")
        links = links.unionAll(_by_hubs(nodes, star, buckets, bits, docs, step))
    label = components(links.unionAll(same), step=step)
    return rows, label, groups, found.groupBy("digest").agg(F.sum("linked").alias("linked"))


def _component():
    return F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach), n_copies (documents of the same set) and n_links (other documents whose set
    links with its own, equal ones included; the sum over all documents is twice the number of links) of every document.

    docs: doc_id and text; other columns are ignored. Null or wordless texts have an empty set and link with nothing; a text of one to four words is one
    shingle. Rows of one doc_id are one node, of the links of all their texts; n_copies and n_links are of the row's own text, and count rows. A null doc_id has a size
    but no component and no links.
    often=1 / 8000: the share of sets from which a token is frequent, very=1 / 400: from which it is very frequent. There are at most mean set size / often frequent ones,
    and only they and a bitmap of 4 MB are broadcast.
    """
    docs = _narrow(docs)
    with steps(docs.sparkSession) as step:
        rows, label, groups, found = _labelled(docs, step, **options)
        links = groups.join(found, "digest", "left").select("digest", "n_copies", (F.coalesce("linked", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
        out = rows.join(label, F.col("doc_id") == F.col("node"), "left").join(links, "digest", "left")
        return materialize(out.select("doc_id", F.col("n").alias("n_shingles"), _component(), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "ngram-join")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id; rows with a null doc_id stay."""
    with steps(docs.sparkSession) as step:
        rows, label, _, _ = _labelled(_narrow(docs), step, counts=False, **options)
        gone = rows.join(label, F.col("doc_id") == F.col("node"), "left").select("doc_id", _component()).where("component_id <> doc_id").select("doc_id").distinct()
        gone = materialize(gone, "ngram-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

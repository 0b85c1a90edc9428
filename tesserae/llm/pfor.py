"""Token ids in files of patched frame-of-reference blocks.

A shard holds the ids of documents in ascending order as blocks of 128. A block stores its minimum and each id's difference from
it in w bits, w being enough for a chosen percentile of the block's differences; a larger difference has its low w bits there, and
its place and high bits in the block's exception list. Layout, little-endian:

    "PFR1"
    blocks: minimum u32, width u8, exceptions u8, packed 16 * width bytes, places u8 each, high parts u32 each
    block starts u64 each | doc_ids i64 each | 1 for a null doc_id, u8 each | token counts u32 each
    number of ids u64, of blocks u64, of documents u64, "PFR1"

Block starts let a reader go to any id: id i is in block i // 128.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import materialize, shared_path, trimmed
from tesserae.llm.tokens import default_path, encoder

MAGIC, BLOCK = b"PFR1", 128


def _pack(v: np.ndarray, w: int) -> np.ndarray:
    """Blocks of values below 2**w as rows of 16 * w bytes."""
    out = np.zeros((2 * w, len(v)), np.uint64)
    for i, column in enumerate(np.ascontiguousarray(v.T, np.uint64)):
        word, shift = divmod(i * w, 64)
        out[word] |= column << np.uint64(shift)
        if shift + w > 64:
            out[word + 1] |= column >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).view(np.uint8).reshape(len(v), 16 * w)


def _unpack(packed: np.ndarray, w: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").T)
    out = np.zeros((BLOCK, len(packed)), np.uint64)
    mask = np.uint64((1 << w) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * w, 64)
        v = words[word] >> np.uint64(shift)
        if shift + w > 64:
            v = v | words[word + 1] << np.uint64(64 - shift)
        out[i] = v & mask
    return out.T


def _bits(v: np.ndarray) -> np.ndarray:
    """Bit lengths of values below 2**32."""
    return np.frexp(v.astype(np.float64))[1].astype(np.int64)


def encode_blocks(ids: np.ndarray, percentile: float = 0.9) -> tuple[bytes, np.ndarray]:
    """Bytes of the blocks of ids, the last filled up with its minimum, and each block's start in them."""
    n = -(-len(ids) // BLOCK)
    v = np.empty(n * BLOCK, np.uint64)
    v[: len(ids)] = ids
    if len(ids) % BLOCK:
        v[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    v = v.reshape(n, BLOCK)
    low = v.min(axis=1)
    v = v - low[:, None]
    width = _bits(np.partition(v, int(percentile * (BLOCK - 1)), axis=1)[:, int(percentile * (BLOCK - 1))])
    over = v >> width.astype(np.uint64)[:, None]
    patched = over > 0
    count = patched.sum(axis=1)
    size = 6 + 16 * width + 5 * count
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[start[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    out[start + 4], out[start + 5] = width, count
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        out[start[of][:, None] + 6 + np.arange(16 * w)] = _pack(v[of] & np.uint64((1 << w) - 1), w)
    row, place = np.nonzero(patched)
    rank = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    after = start[row] + 6 + 16 * width[row]
    out[after + rank] = place
    out[(after + count[row] + 4 * rank)[:, None] + np.arange(4)] = over[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), start


def decode_blocks(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start there in data, 128 a block."""
    n = len(start)
    start = start.astype(np.int64)
    low = np.ascontiguousarray(data[start[:, None] + np.arange(4)]).view("<u4")[:, 0].astype(np.uint64)
    width, count = data[start + 4].astype(np.int64), data[start + 5].astype(np.int64)
    out = np.zeros((n, BLOCK), np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        out[of] = _unpack(data[start[of][:, None] + 6 + np.arange(16 * w)], w)
    row = np.repeat(np.arange(n), count)
    rank = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    after = start[row] + 6 + 16 * width[row]
    high = np.ascontiguousarray(data[(after + count[row] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").reshape(-1).astype(np.uint64)
    out[row, data[after + rank]] |= high << width[row].astype(np.uint64)
    return (out + low[:, None]).reshape(-1)


class Writer:
    """Appends documents' ids to an open binary file."""

    def __init__(self, file, percentile: float = 0.9):
        self._file, self._percentile = file, percentile
        self._at = file.write(MAGIC) or len(MAGIC)
        self._rest = np.zeros(0, np.uint32)
        self._starts: list[np.ndarray] = []
        self._docs: list[int | None] = []
        self._sizes: list[np.ndarray] = []
        self.ids = 0

    def _blocks(self, ids: np.ndarray) -> None:
        if len(ids):
            data, start = encode_blocks(ids, self._percentile)
            self._file.write(data)
            self._starts.append(start + self._at)
            self._at += len(data)

    def append(self, doc_ids: list[int | None], ids: np.ndarray, offs: np.ndarray) -> None:
        self._docs += doc_ids
        self._sizes.append(np.diff(offs).astype("<u4"))
        self.ids += len(ids)
        ids = np.concatenate([self._rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole])
        self._rest = ids[whole:]

    def close(self) -> None:
        self._blocks(self._rest)
        starts = np.concatenate([np.zeros(0, np.int64), *self._starts]).astype("<u8")
        self._file.write(starts.tobytes())
        self._file.write(np.array([d or 0 for d in self._docs], "<i8").tobytes())
        self._file.write(np.array([d is None for d in self._docs], np.uint8).tobytes())
        self._file.write(np.concatenate([np.zeros(0, "<u4"), *self._sizes]).astype("<u4").tobytes())
        self._file.write(np.array([self.ids, len(starts), len(self._docs)], "<u8").tobytes() + MAGIC)
        self._file.close()


class Reader:
    """Reads a file of Writer's, whole or in part."""

    def __init__(self, data: bytes | np.ndarray):
        self._data = np.frombuffer(data, np.uint8)
        if self._data[:4].tobytes() != MAGIC or self._data[-4:].tobytes() != MAGIC:
            raise ValueError("not a whole shard of patched blocks")
        self.ids, blocks, docs = np.frombuffer(self._data[-28:-4].tobytes(), "<u8").astype(np.int64).tolist()
        at = len(self._data) - 28 - 8 * blocks - 13 * docs

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            at += size
            return np.frombuffer(self._data[at - size : at].tobytes(), kind)

        self.starts = take("<u8", blocks)
        doc_ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if x else d for d, x in zip(doc_ids.tolist(), null.tolist())]
        self.offs = np.concatenate([[0], np.cumsum(take("<u4", docs), dtype=np.int64)])

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi - 1 of the shard; only their blocks are decoded."""
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first = lo // BLOCK
        got = decode_blocks(self._data, self.starts[first : -(-hi // BLOCK)])
        return got[lo - first * BLOCK : hi - first * BLOCK].astype(np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.slice(int(self.offs[i]), int(self.offs[i + 1]))


_MANIFEST = "first_id long, shard string, n_docs long, n_ids long"


def write(docs: DataFrame, folder: str, end_id: int = 1, tokenizer: str | None = None, percentile: float = 0.9) -> DataFrame:
    """Encode every text, append end_id to each, and write the ids in ascending doc_id order to shards in a shared folder.

    docs: doc_id (null first; rows of one id by text) and text (null as empty); other columns are ignored. A task writes its shard under
    the attempt's own name, so one that is run again can't spoil a file in use; the manifest names the files of the tasks that counted.
    Returns the manifest: first_id, shard, n_docs, n_ids; empty for no documents.
    """
    path = tokenizer or default_path()

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            doc_ids = batch.column(0).to_pylist()
            if writer is None:
                task = TaskContext.get()
                fs, at = pafs.FileSystem.from_uri(folder)
                fs.create_dir(at, recursive=True)
                name, first, n = f"{at}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.pfr", doc_ids[0], 0
                writer = Writer(fs.open_output_stream(name), percentile)
            for lo, hi, ids, offs in encoder(path).encode_column(batch.column(1), end_id, 1 << 20):
                writer.append(doc_ids[lo:hi], ids, offs)
                n += hi - lo
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"first_id": pa.array([first], pa.int64()), "shard": [name], "n_docs": [n], "n_ids": [writer.ids]})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(trimmed(save), _MANIFEST)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the shards' bytes."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(name) as f:
                    shard = Reader(f.read())
                offs, lo = shard.offs, 0
                while lo < len(shard.doc_ids):
                    hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + (1 << 20), "right")) - 1)
                    ids = np.ascontiguousarray(shard.slice(int(offs[lo]), int(offs[hi])), "<u4")
                    ends = (offs[lo : hi + 1] - offs[lo]).tolist()
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:])]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids[lo:hi], pa.int64()), "start": pa.array(offs[lo:hi] + base), "n_tokens": pa.array(np.diff(offs[lo : hi + 1])), "ids_crc32": pa.array(crc, pa.int64())})
                    lo = hi

    # one row a shard: the window over all of them holds as many rows as there are files
    before = Window.orderBy(F.asc_nulls_first("first_id"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return placed.repartition(max(1, manifest.count())).mapInArrow(trimmed(load), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the shards to a new folder under spark.checkpoint.dir, then read them."""
    folder = shared_path(docs.sparkSession, "pfor")
    return read(materialize(write(docs, folder, **options), "manifest"), folder)

import zlib

import numpy as np
import pytest

from tesserae.llm import packing, pfor, tokens


def brute(rows, end):
    tok = tokens.encoder(tokens.default_path())._tok
    return {d: [*tok.encode(t or "", add_special_tokens=False).ids, end] for d, t in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ROWS = [(1, "The  Cat*** don't\nsat"), (2, None), (3, ""), (4, "word " * 9000), (5, "a b c"), (6, "a b c"), (70000000000, "é ß 🙂"), (-3, "x"), *[(100 + i, "lorem ipsum " * i) for i in range(300)]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'x' as start", "1 as offset", "'y' as part").repartition(5)


def test_pack(spark, docs):
    want, got = brute(ROWS, 2), packing.pack(docs).collect()
    by, seq = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    assert by.keys() == want.keys()
    for d, rs in by.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[d]) and r.ids_crc32 == crc(want[d][at : at + r.length])
            at += r.length
        assert at == len(want[d])
    padding = 0
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < 0.03 * sum(map(len, want.values()))


def test_pack_empty_and_odd(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = packing.pack(spark.createDataFrame([(None, "a"), (7, "b"), (7, "b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 2), (7, 2), (7, 2)]


def test_cut():
    for n in range(1, 9000, 7):
        parts = packing.cut(n, 4096, 0.01)
        assert sum(parts) == n and max(parts) <= 4096
        assert all((4096 // p) * p >= 0.98 * 4096 for p in parts if p > 64)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks(n):
    r = np.random.default_rng(n)
    for top in (1, 2, 300, 49408, 2**32):
        ids = r.integers(0, top, n).astype(np.uint32)
        if n > 3 and top == 300:
            ids[3] = 2**32 - 1
        data, start = pfor.encode_blocks(ids) if n else (b"", np.zeros(0, np.int64))
        assert (pfor.decode_blocks(np.frombuffer(data, np.uint8), start)[:n] == ids).all()


def test_files(spark, docs):
    want, got = brute(ROWS, 1), pfor.round_trip(docs).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want[r.doc_id]), crc(want[r.doc_id]))
        at += r.n_tokens
    assert len(got) == len(ROWS)


def test_files_odd(spark):
    assert pfor.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = pfor.round_trip(spark.createDataFrame([(2, "b"), (None, "a"), (2, "a b")], "doc_id long, text string")).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (2, 2, 3), (2, 5, 2)]
    import io

    f = io.BytesIO()
    f.close = lambda: None
    w = pfor.Writer(f)
    w.append([1, 2], np.arange(300, dtype=np.uint32), np.array([0, 100, 300]))
    w.close()
    shard = pfor.Reader(f.getvalue())
    assert shard.document(1).tolist() == list(range(100, 300)) and shard.slice(130, 140).tolist() == list(range(130, 140))
    with pytest.raises(ValueError):
        pfor.Reader(f.getvalue()[:-1])


def test_cuts_leave_no_shreds():
    spare = whole = 0
    for n in [*range(1, 4097), 9000, 50_001]:
        cut = packing.cut(n, 4096, 0.01, 64)
        assert sum(cut) == n and min(cut) >= min(64, n % 4096 or 4096)
        spare += sum((4096 - 4096 // x * x) / (4096 // x) for x in cut)
        whole += n
    assert spare < 0.01 * whole

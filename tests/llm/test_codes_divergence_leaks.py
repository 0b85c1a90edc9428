"""Vector codes, divergence of sources and decontamination against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import decontaminate, divergence, vector_codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(k, label, [math.floor(1024 * x) for x in v]) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2])
    kept = [r for r in kept if len(r[2]) == width]
    cut = [(width * p // parts, width * (p + 1) // parts) for p in range(parts)]
    books = [[r[2][a:b] for r in kept[:entries]] for a, b in cut]

    def find(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            groups = defaultdict(list)
            for r in kept:
                groups[find(r[2][a:b], books[p])[1]].append(r[2][a:b])
            books[p] = [[sum(c) // len(c) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for k, label, v in kept:
        got = [find(v[a:b], books[p]) for p, (a, b) in enumerate(cut)]
        out.append((k, label, "".join(f"{i:02x}" for _, i in got), sum(d for d, _ in got)))
    sums = Counter()
    for r in out:
        sums[r[1]] += r[3]
    return sorted(((k, code, e, sums[label], digest) for k, label, code, e in out), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, code int, extra string"


@pytest.mark.parametrize("seed,n,width,big", [(1, 400, 8, 1.0), (2, 30, 8, 1.0), (3, 60, 6, 3e5), (4, 40, 8, 0.004)])
def test_vector_codes(spark, seed, n, width, big):
    g = random.Random(seed)
    rows = [(i, [g.gauss(0, big) for _ in range(width)], g.choice([None, 0, 1, 2])) for i in range(n)]
    rows += [rows[3], rows[3], (n, None, 1), (n + 1, [None] + [0.0] * (width - 1), 1), (n + 2, [math.nan] * width, None), (n + 3, [math.inf] * width, 0), (n + 4, [-math.inf] * width, 0), (None, [0.25] * width, 2), (n + 5, [1.0] * (width + 1), 0)]
    rows += [(n + 10 + i, [0.5] * width, 7) for i in range(100)]
    df = spark.createDataFrame([(k, v, label, 1, "x") for k, v, label in rows], SCHEMA).repartition(5)
    exact = [(k, v if v is None else [x if x is None else float(np.float32(x)) for x in v], label) for k, v, label in rows]
    assert sorted((tuple(r) for r in vector_codes.report(df).collect()), key=repr) == brute_codes(exact)


def test_vector_codes_odd_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert vector_codes.report(df).collect() == [] and vector_codes.train(df) is None
    df = spark.createDataFrame([(1, [], 3, 1, "x"), (2, None, 3, 1, "y")], SCHEMA)
    assert [tuple(r)[:4] for r in vector_codes.report(df).collect()] == [(1, "00000000", 0, 0)]
    vast = spark.createDataFrame([(1, [1e30] * 4, 3, 1, "x"), (2, [1e20, 0.0, 0.0, 0.0], 3, 1, "y"), (3, [0.0] * 4, 3, 1, "z")], SCHEMA)
    assert sorted((r.vec_id, r.code, r.error) for r in vector_codes.report(vast).collect()) == [(2, "00000000", 0), (3, "01000000", 0)]
    df = spark.createDataFrame([(i, [i / 10.0, 1.0, 2.0, -3.5], 3, 1, "x") for i in range(5)], SCHEMA)
    model = vector_codes.train(df)
    got = vector_codes.decode(vector_codes.encode(df, model).join(df.select("vec_id", "embedding"), "vec_id"), model).collect()
    assert all(abs(a - b) < 0.001 for r in got for a, b in zip(r.decoded, r.embedding)) and {"extra", "label", "code", "error"} <= set(got[0].asDict())


def brute_divergence(rows, least=10, top=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        of = Counter(w for d in own for w in set(d[2]))
        kept = sorted((w for w, n in of.items() if n >= least), key=str.encode)
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, words in own:
            counts[s].update(w for w in words if of[w] >= least)
        whole = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 1000000000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = sorted(((-sum(apart(p[s][w], p[t][w]) for w in kept), t.encode()) for t in counts if t != s))
            out += [(lang, s, "pair", t.decode(), -v, i) for i, (v, t) in enumerate(pairs, 1)]
            terms = sorted((-apart(p[s][w], q[w]), w.encode()) for w in kept if counts[s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, "term", w.decode(), -v, i) for i, (v, w) in enumerate(terms, 1)]
    return sorted(out)


def odd_documents(seed=0):
    g = random.Random(seed)
    vocabulary = ["a", "B", "ab", "été", "ЖУК", "жук", "z" * 300, "漢字", "Éa", "x", "y", *(f"w{c}{d}" for c in "abcdefghij" for d in "klmnopq")]
    rows = [(g.choice(["en", "en", "de", None]), g.choice(["hot", "hot", "s1", "s2", "s3", "", None]), " ".join(g.choices(vocabulary, k=g.randint(0, 60))) + g.choice(["", "\n1-2", "\x00Q"])) for _ in range(300)]
    return rows + [("en", "only nulls", None), ("xx", "s1", "rare words here"), ("xx", "s2", None), ("yy", "alone", "b"), ("en", "s1", "a " * 30000)] + [("en", "copies", "same a b text x")] * 50


@pytest.mark.parametrize("sizes", [(1 << 16, 1024, 512, 1 << 19), (16, 4, 2, 50)])
def test_divergence(spark, monkeypatch, sizes):
    for name, value in zip(("CELLS", "LEAST", "BLOCK", "HELD"), sizes):
        monkeypatch.setattr(divergence, name, value)
    rows = odd_documents()
    df = spark.createDataFrame([(i, *r, 5) for i, r in enumerate(rows)], "term long, lang string, source string, text string, n int").repartition(4)
    assert sorted(map(tuple, divergence.audit(df).collect())) == brute_divergence(rows)
    assert divergence.audit(df.limit(0)).collect() == []


def test_shares_are_exact():
    count, total = np.array([0, 5, 2**50, 2**52 + 12345]), np.int64(2**52 + 12345)
    assert divergence.share(count, total, 7).tolist() == [1 + 1000000000 * (c + 2) // (int(total) + 14) for c in count.tolist()]


def brute_leaks(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for a in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[a : a + size])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for a in range(len(w)):
            for n in {len(x) for x in windows}:
                if a + n <= len(w) and tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEM = "What is the Capital of the old French Republic and which river runs through it?"


def leaky():
    g = random.Random(5)
    few = [g.choice("abcd") for _ in range(400)]
    items = [(1, ITEM), (2, "Short item, of FIVE"), (10, "été 漢字"), (3, None), (4, ""), (5, "?!"), (None, "nobody's item"), (1, "a second row of item one"), (6, " ".join(few[:30])), (7, " ".join(few[20:45])), (7, " ".join(few[20:45]))]
    docs = [(1, f"So: {ITEM} Paris."), (2, "what-is THE capital of the old french republic and, which"), (3, "what is the capital of the old french republic and"), (4, "xshort item of five"), (5, "short\nitem\tOF five5 short item of five"), (6, "été?漢字"), (16, "Été?漢字"), (7, None), (8, ""), (9, "this is nobody s item here"), (9, "this is nobody s item here"), (11, " ".join(few)), (12, ("filler words " * 20000) + ITEM), (13, "a second row of item one two"), (14, "x\x00short item of five\x00")]
    return docs, items


@pytest.mark.parametrize("piece_bytes", [1 << 19, 40])
def test_decontamination(spark, piece_bytes):
    docs, items = leaky()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_hit int, item string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = decontaminate.scan(df, bench, piece_bytes=piece_bytes)
    assert got.columns == ["doc_id", "text", "item", *decontaminate.NEW]
    rows = got.collect()
    plain = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in rows), key=repr)
    assert plain == brute_leaks(docs, items)
    for r in rows:
        assert sum(len(decontaminate.words_of(r.text[s.start : s.end].encode())) for s in r.spans) == r.n_hit
    cut = {r.doc_id: r.text for r in decontaminate.without(got).collect()}
    assert cut[1] == "So: ? Paris." and cut[7] is None and cut[6] == "" and cut[4] == "xshort item of five" and cut[14] == "x\x00\x00"
    assert sorted((tuple(r) for r in decontaminate.report(df, bench).collect()), key=repr) == brute_leaks(docs, items)


def test_long_items_are_cut_into_pieces(spark, monkeypatch):
    g = random.Random(6)
    words = [f"w{g.randint(0, 50)}" for _ in range(5000)]
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    docs, items = [(1, " ".join(words[1000:1100])), (2, " ".join(words[:9])), (3, " ".join(words[:10]))], [("b", " ".join(words)), ("a", " ".join(words[1050:1080]))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert sorted((tuple(r) for r in decontaminate.report(df, bench).collect()), key=repr) == brute_leaks(docs, items)


def test_decontamination_of_empty_tables(spark):
    df, bench = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.report(df.limit(0), bench).collect() == []
    assert [(r.n_words, r.n_hit) for r in decontaminate.report(df, bench.limit(0)).collect()] == [(3, 0)]
    assert [(r.n_words, r.n_hit) for r in decontaminate.report(df, bench.withColumn("text", F.lit(None).cast("string"))).collect()] == [(3, 0)]


def test_counts_of_a_task_are_handed_on(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    batch = pa.record_batch([pa.array(["en"] * 3), pa.array(["s"] * 3), pa.array(["a b c d", "a", ""])], ["lang", "source", "text"])
    total = Counter()
    for b in divergence._count(iter([batch])):
        for r in b.to_pylist():
            total[r["term"], "n"] += r["n"]
    assert {k[0]: v for k, v in total.items() if k[0][0] != "\0"} == {"a": 2, "b": 1, "c": 1, "d": 1}

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa

from tesserae.llm import langid, line_dedup, mixing, quality_classifier, simhash, textvec


# fingerprints


def prints(texts):
    return [f.tobytes().hex() for f in simhash._column(pa.array(texts, pa.string()))]


def test_fingerprints(spark):
    rows = [(3, "a b c d " * 9), (10, "Hello wörld, this is a test"), (-4, None), (11, ""), (12, "Hello wörld, this is a test"), *[(100 + i, " ".join(f"w{(i * j) % 97}" for j in range(60))) for i in range(60)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_chars", "2 as bucket").repartition(4)
    got = {r.doc_id: r for r in simhash.report(df, every=2).collect()}
    ids = sorted(d for d, _ in rows)
    text = {d: t or "" for d, t in rows}
    assert got.keys() == text.keys()
    fp = dict(zip(ids, prints([text[d] for d in ids])))
    for i, d in enumerate(ids):
        t, nxt = text[d], text[ids[(i + 1) % len(ids)]]
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), fp[d], *prints([edited]))

        def like(a, b):
            return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128

        assert r.near_edited == like(fp[d], r.edited_fingerprint) and r.near_next == like(fp[d], fp[ids[(i + 1) % len(ids)]])
        near = sum(like(fp[d], fp[e]) >= 1 - 3 / 128 for e in ids) - 1
        assert r.n_within == (near if d % 2 == 0 else None)
    assert got[10].fingerprint == got[12].fingerprint


def plain_print(text):
    """Votes word by word, in Python's integers."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    times = Counter(w for w in low.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w)

    def mix(h):
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) % 2**64
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) % 2**64
        return h ^ h >> 31

    votes = [0] * 128
    for w, n in times.items():
        h = sum(int(textvec._BYTE[b]) * pow(textvec._BASE, i, 2**64) for i, b in enumerate(w)) % 2**64
        word = mix(h ^ len(w) * int(textvec._GRAM) % 2**64) >> 24
        terms = mix(word).to_bytes(8, "little") + mix(word ^ 0x5851F42D4C957F2D).to_bytes(8, "little")
        weight = round(64 * (1 + math.log(n)))
        for i in range(128):
            votes[i] += weight if terms[i // 8] >> (7 - i % 8) & 1 else -weight
    return "".join(f"{int(''.join('1' if v > 0 else '0' for v in votes[i : i + 8]), 2):02x}" for i in range(0, 128, 8))


def test_fingerprints_against_plain_votes():
    g = random.Random(3)
    texts = [None, "", "a", "A a\tB\nb", "ünd\x0bÜnd und", " ".join(g.choices([f"W{i}" for i in range(50)], k=400)), "x" * 70000, *(" ".join(g.choices("abcdefgh", k=g.randint(1, 30))) for _ in range(40))]
    assert prints(texts) == [plain_print(t) for t in texts]


def test_neighbours_by_class(spark):
    g = random.Random(8)

    def near(x, most):
        return x ^ sum(1 << b for b in g.sample(range(128), g.randint(0, most)))

    one, two = g.getrandbits(128), g.getrandbits(128)
    fp = {*(near(one, 6) for _ in range(300)), *(near(two, 14) for _ in range(80)), *(near(near(one, 14), 2) for _ in range(40)), *(g.getrandbits(128) for _ in range(200))}
    rows = [(f"{x:032x}", g.randint(1, 4)) for x in sorted(fp)]
    df = spark.createDataFrame([*rows, (None, 1)], "fingerprint string, n long").repartition(4)
    asked = df.where("pmod(hash(fingerprint), 3) = 0")
    for radius, crowd in ((14, 3), (14, 16), (3, 4), (9, 10**6)):
        got = {r.query: r.n for r in simhash.neighbours(asked, df, radius, crowd).collect()}
        assert got == {q.fingerprint: sum(n for f, n in rows if (int(f, 16) ^ int(q.fingerprint, 16)).bit_count() <= radius) for q in asked.where("fingerprint is not null").collect()}


def test_blocks_grow_with_the_number_of_fingerprints():
    widths = []
    for n in (10, 10**4, 10**6, 10**9, 10**12):
        flips, cuts = simhash.layout(14, n)
        assert (flips + 1) * len(cuts) > 14 and cuts[0][0] == 0 and cuts[-1][1] == 32 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
        widths.append(min(b - a for a, b in cuts))
    assert widths == sorted(widths) and widths[0] < widths[-1]


def test_a_very_long_text_among_others(spark):
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    df = spark.createDataFrame([(1, "short one"), (2, long), (3, None), (2, long)], "doc_id long, text string")
    got = simhash.report(df, every=2).collect()
    assert {(r.doc_id, r.fingerprint) for r in got} == set(zip((1, 2, 3), prints(["short one", long, None]))) and sorted(r.n_within for r in got if r.doc_id == 2) == [1, 1]


def test_edited_copies_are_found(spark):
    r = random.Random(9)
    base = [[f"w{r.randint(0, 9000)}" for _ in range(n)] for n in (60, 100, 200, 400) for _ in range(5)]
    copies = [[w if i not in at else f"x{i}" for i, w in enumerate(t)] for t in base for at in [set(r.sample(range(len(t)), len(t) // 50))]]  # 5-shingle similarity over 0.8
    fp = prints([" ".join(t) for t in base + copies])
    df = spark.createDataFrame([(f,) for f in fp], "fingerprint string")
    for radius in (3, 9, simhash.RADIUS):
        want = {(a, b, d) for a in fp for b in fp if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= radius}
        assert {tuple(x) for x in simhash.within(df, df, radius).collect()} == want
    found = {(a, b) for a, b, _ in want}
    assert sum((a, b) in found for a, b in zip(fp, fp[len(base) :])) >= 19
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(base + copies)], "doc_id long, text string")
    got = simhash.report(docs, radius=simhash.RADIUS, every=1).collect()
    assert sum(g.n_within >= 1 for g in got) >= 38


def test_fingerprints_odd(spark):
    assert simhash.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (r,) = simhash.compare(spark.createDataFrame([(5, "abcd efgh")], "doc_id long, text string")).collect()
    assert r.near_next == 1 and r.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest()
    got = simhash.compare(spark.createDataFrame([(None, "nnnn"), (5, "bbbb"), (5, "aaaa"), (6, "cccc")], "doc_id long, text string").repartition(3)).collect()
    order = ["nnnn", "aaaa", "bbbb", "cccc"]
    assert sorted(r.edited_sha256 for r in got) == sorted(hashlib.sha256((a[:3] + b[:1]).encode()).hexdigest() for a, b in zip(order, [*order[1:], order[0]]))


def test_equal_texts_have_equal_fingerprints_anywhere():
    t = "one two two three three three ünd so weiter"
    assert len(set(prints([t, "x " * 50, t, None, t]))) == 3


# lines


def test_line_dedup(spark):
    r = random.Random(5)
    pool = ["Common", " common\t", "COMMON", "É x", "é x", "", "  ", "rare", "b\x0c", "\x85z"] + [f"line {i}" for i in range(30)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 9)))) for i in range(150)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as n_lines", "1 as _n").repartition(3)
    got = line_dedup.digest(df).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    documents = df.select("doc_id", "text").toPandas()
    con.register("documents", documents)
    want = con.sql(line_dedup.SQL).df().sort_values("doc_id").reset_index(drop=True)
    for c in want.columns:
        assert (got[c] == want[c]).all(), c
    assert (got.n_dropped > 0).any()
    out = line_dedup.dedup(df)
    assert out.columns == ["doc_id", "text", "_n", "n_lines", "n_dropped"]
    assert line_dedup.digest(df.limit(0)).count() == 0


def test_line_dedup_counts_documents(spark):
    """Rows of one doc_id are one document, null ids are none, and names that the operator uses inside may be columns."""
    rows = [(1, "same\nown", "x")] * 12 + [(None, "null line\nsame\nmany", "x")] * 12 + [(100 + i, f"many\ntext {i}\n many", "y") for i in range(10)] + [(7, "word " * 200_000 + "\nMANY", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string").selectExpr("*", "1 as _doc", "2 as _gone", "3 as _id", "4 as _place", "5 as _one").repartition(3)
    for few in (0, line_dedup.FEW):
        line_dedup.FEW = few
        got = line_dedup.dedup(df).collect()
        assert line_dedup.dedup(df).columns == [*df.columns, "n_lines", "n_dropped"] and len(got) == len(rows)
        assert Counter((r.doc_id, r.text[:40], r.n_lines, r.n_dropped, r._gone) for r in got) == Counter(
            [(1, "same\nown", 2, 0, 2)] * 12 + [(None, "null line\nsame", 3, 1, 2)] * 12 + [(100 + i, f"text {i}", 3, 2, 2) for i in range(10)] + [(7, ("word " * 8), 2, 1, 2)]
        )


# mixing


def test_plan_keeps_every_share_within_a_block():
    r = random.Random(2)
    for _ in range(30):
        w = {f"s{i}": r.choice([0.01, 1, 1, 5, 20 * r.random() + 0.1]) for i in range(r.randint(1, 12))}
        total, done, n = sum(map(Fraction, w.values())), Counter(), 64 * len(w)
        for i, (s, j, slot, release, deadline) in zip(range(n), mixing.plan(w, {s: n for s in w})):
            assert slot == i and release <= slot < deadline and j == done[s]
            done[s] += 1
            assert all(abs(done[x] - Fraction(w[x]) * (slot + 1) / total) < 1 for x in w)


def test_mix(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a"] * 8 + ["b", "c", None])) for i in range(1500)] + [(None, "a"), (7, "a"), (7, "a")]
    df = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "'x' as slot", "3 as _n", "4 as _src", "5 as _position", "6 as release").repartition(3)
    got = mixing.mix(df).orderBy("position").collect()
    assert [g.position for g in got] == list(range(len(rows)))
    assert [(g.slot, g.source or "") for g in got] == sorted((g.slot, g.source or "") for g in got)
    counts = Counter(s for _, s in rows)
    for s in counts:
        own = [g for g in got if g.source == s]
        key = [(hashlib.md5(("" if g.doc_id is None else str(g.doc_id)).encode()).hexdigest()) for g in own]
        assert key == sorted(key) and [g.block for g in own] == [i // 16 for i in range(len(own))]
    weights = mixing.temperature(counts)
    total = sum(weights.values())
    ends = min(-(-n // 16) * total / weights[s] for s, n in counts.items())
    for t in range(1, int(ends)):
        for s in counts:
            done = len({g.block for g in got if g.source == s and g.slot < t})
            assert abs(done - weights[s] * t / total) < 1
    assert mixing.mix(df.limit(0)).count() == 0
    out = mixing.ordered(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert [x.doc_id for x in out.collect() if x.doc_id != 7] == [g.doc_id for g in got if g.doc_id != 7]
    con = duckdb.connect()
    documents = df.where("doc_id is not null and doc_id <> 7").select("doc_id", "source").toPandas()
    con.register("documents", documents)
    same = mixing.mix(spark.createDataFrame(documents, "doc_id long, source string"))
    want = con.sql(f"SELECT {', '.join(same.columns)} FROM ({mixing.SQL})").fetchall()
    assert sorted(map(tuple, same.collect()), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    given = mixing.mix(df, weights={"a": 1, "b": 5}).orderBy("position").collect()
    assert Counter(g.source for g in given) == counts and Counter(g.source for g in given[:64])["b"] > 16


def test_plan_keeps_the_given_weights_over_many_periods():
    r = random.Random(6)
    for w in ({"a": 1e6, "b": 1}, {"hot": 50.0, **{f"t{i}": 0.01 for i in range(30)}}, *({f"s{i}": r.random() + 0.01 for i in range(7)} for _ in range(5))):
        total, done, n = sum(map(Fraction, w.values())), Counter(), 20_000
        for i, (s, j, slot, release, deadline) in zip(range(n), mixing.plan(w, {s: n for s in w})):
            assert slot == i and j == done[s] and (release <= slot < deadline)
            done[s] += 1
            if i % 7 == 0 or i > n - 50:
                assert all(abs(done[x] - Fraction(w[x]) * (slot + 1) / total) < 1 for x in w)


def test_mix_keeps_weights_and_long_plans(spark, monkeypatch):
    df = spark.range(6000).selectExpr("id doc_id", "if(id % 2 = 0, 'a', 'b') source").repartition(3)
    w = {"a": 1000, "b": 1}
    want = mixing.mix(df, weights=w, block=1).orderBy("position").collect()
    assert 2 <= sum(g.source == "b" for g in want[:2900]) <= 3  # 2.9 by weight; over 20 by whole blocks of a period
    assert [g.position for g in want] == list(range(6000))
    monkeypatch.setattr(mixing, "CHUNK", 1000)
    assert mixing.mix(df, weights=w, block=1).orderBy("position").collect() == want


# quality


def labelled(spark, n=600):
    r = random.Random(4)
    good = [f"{a}{b}" for a in ("tion", "ing", "ther", "and", "ere") for b in ("s", "ly", "ed", "al")]
    rows = []
    for i in range(n):
        words = [r.choice(good) for _ in range(r.randint(30, 200))]
        y = i % 2
        rows.append((i, " ".join(words) if y else r.choice([" | ".join(words), " ".join(w + r.choice(["***", "%%%"]) for w in words), (words[0] + " ") * 100]), y, r.randint(0, 1)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def test_quality_classifier(spark):
    df = labelled(spark)
    docs = df.select("doc_id", "text").unionAll(spark.createDataFrame([(None, "a"), (9000, None), (9001, ""), (9002, "x" * 300_000)], "doc_id long, text string")).selectExpr("*", "9 as score")
    got = quality_classifier.classify(docs, df.select("doc_id", "quality", "toxic"))
    rows = got.collect()
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == 604
    y = {r.doc_id: r.quality for r in df.collect()}
    out = [r for r in rows if r.held_out and r.doc_id in y]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == y[r.doc_id] for r in out]) > 0.95
    assert sorted((r.doc_id or -1, r.score) for r in rows) == sorted((r.doc_id or -1, r.score) for r in quality_classifier.classify(docs.repartition(2), df).collect())
    none = quality_classifier.classify(docs, df.limit(0).select("doc_id", "quality")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_classifier.classify(docs.limit(0), df).count() == 0


# language


def test_gradients():
    net = langid.Network(["a", "b", "c"], hidden=5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = langid.arrays([b"abc", b" q", b"xyzzy "])
    y = np.array([0, 1, 2])
    _, g = net.gradients(x, mask.astype(np.float64), y)
    r = np.random.default_rng(0)
    for k, v in net.p.items():
        for _ in range(6):
            at = tuple(r.integers(0, s) for s in v.shape)
            if k.startswith("w"):
                at = (int(r.choice([97, 98, 99, 32, 113])), at[1])
            old, loss = v[at], []
            for d in (1e-4, -1e-4):
                v[at] = old + d
                loss.append(net.gradients(x, mask, y)[0])
            v[at] = old
            # states are kept in single precision
            assert abs((loss[0] - loss[1]) / 2e-4 - g[k][at]) < 2e-3 + 0.05 * abs(g[k][at])


def slow_labels(net, text):
    """Log-probabilities of every place of one sequence, byte by byte."""

    def read(name, some):
        w, u, b = (net.p[f"{k}{name}"].astype(float) for k in "wub")
        h, state, out = u.shape[0], np.zeros(u.shape[0]), []
        for x in some:
            a = w[x] + b
            z, r = (1 / (1 + np.exp(-(a[k * h : (k + 1) * h] + state @ u[:, k * h : (k + 1) * h]))) for k in (0, 1))
            c = np.tanh(a[2 * h :] + (r * state) @ u[:, 2 * h :])
            state = z * state + (1 - z) * c
            out.append(state)
        return out

    both = [np.concatenate(p) for p in zip(read("f", text), read("b", text[::-1])[::-1])]
    logits = np.array(both) @ net.p["v"] + net.p["c"]
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def test_every_position_is_labelled_once_in_its_context():
    r = random.Random(8)
    net = langid.Network(["a", "b", "c"], hidden=6, seed=4)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 9, 10, 11, 25, 64, 3, 10)]
    got = langid.Labeller(net, window=10, context=4, batch=3).means(texts)
    for t, g in zip(texts, got):
        total = np.zeros(3)
        for at in range(0, len(t), 10):
            begin = max(0, at - 4)
            total += slow_labels(net, t[begin : at + 14])[at - begin : at - begin + 10].sum(axis=0)
        assert np.abs(g - total / max(len(t), 1)).max() < 1e-4


def test_language(spark):
    r = random.Random(1)
    syllables = {"en": ["the", "ing", "wh", "sh", "ow"], "de": ["ung", "sch", "ein", "ö", "ich"], "fr": ["eau", "ois", "que", "é", "tion"]}
    rows = [(i, l := r.choice(list(syllables)), " ".join("".join(r.choice(syllables[l]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 40)))) for i in range(400)]
    odd = [(1000, "en", None), (1001, "en", ""), (1002, None, "123 !!"), (1003, None, "schein " * 30000), (1004, None, "ungschein"), (None, None, "que eau")]
    df = spark.createDataFrame([*rows, *odd], "doc_id long, lang string, text string").selectExpr("*", "1 as score").repartition(3)
    got = {x.doc_id: x for x in langid.identify(df, steps=300).collect()}
    assert len(got) == 406
    held = [(got[d].lang_pred, l) for d, l, _ in rows if got[d].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert [got[d].lang_pred for d in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "de", "de"]
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in langid.identify(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_spans_and_hashes():
    texts = ["a b", "", "b a\n", None, "ab ", "b"]
    ((_, _, buf, offs),) = textvec.chunks(pa.array(texts), 1 << 40)
    start, end, first = textvec.spans(buf, offs, textvec.NON_SPACE)
    assert np.diff(first).tolist() == [2, 0, 2, 0, 1, 1]
    h = textvec.Hasher(buf)(start, end)
    words = [w for t in texts for w in (t or "").split()]
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(h)) for j in range(len(h)))


# the classifier's features against a plain loop


def test_classifier_features_against_plain_zstandard(spark):
    import zstandard

    good, bad = [f"the river runs by the old town number {i} and people walk there" for i in range(300)], [f"BUY now!!! $$$ {i} click here click here win {i * 7}" for i in range(300)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    df = spark.createDataFrame([*rows, *rows[:20], (9000, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(600)], "doc_id long, quality int")
    model = quality_classifier.fit(quality_classifier.sample(df, labels))
    one, two = (sorted((r.doc_id, r.text, r.score, r.predicted) for r in quality_classifier.score(df.where("text is not null").repartition(n), model).collect()) for n in (2, 5))
    assert one == two and len(one) == 620  # repeated rows are scored each by itself, and alike
    assert all(len({s for d, _, s, _ in one if d == i}) == 1 for i in range(20))
    assert sum(p == int(d < 300) for d, _, _, p in one) >= 590
    # the same score from plain calls: sizes by either dictionary and by none, and the regression written out
    for _, text, got, _ in one[::37]:
        data = text.encode()
        by = [len(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(data)) for d in (model.good, model.bad)]
        alone = len(zstandard.ZstdCompressor(level=model.level, write_content_size=False).compress(data))
        d, q = (by[1] - by[0]) / max(alone, 1), math.log((alone + 16) / (len(data) + 16))
        x = [(v - c) / s for v, c, s in zip((d, d * d, q, q * q, d * q), model.centre, model.scale)]
        assert abs(got - 1 / (1 + math.exp(-sum(a * b for a, b in zip([*x, 1.0], model.weights))))) < 1e-9

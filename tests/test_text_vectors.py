"""Subword and paragraph vectors against plain versions."""

import hashlib
import math

import numpy as np
import pytest

from tesserae.operators import text_vectors as tv


def plain_parts(word, buckets, least, most):
    marked = f"<{word}>"
    grams = {marked[i : i + n] for n in range(least, most + 1) for i in range(len(marked) - n + 1)}
    return [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % buckets for g in grams]


WORDS = ["walk", "walked", "walking", "talk", "talked", "jump", "jumped", "jumping", "é", "naïve"]


def test_subwords(spark):
    g = np.random.default_rng(0)
    rows = [(w, g.normal(size=3).tolist()) for w in WORDS] + [("nothing", None), (None, [1.0] * 3)]
    df = spark.createDataFrame(rows, "word string, vector array<double>").repartition(3)
    for steps, buckets in ((1, 50), (4, 10**6)):
        got = {r.bucket: r.vector for r in tv.subword_vectors(df, 3, steps, buckets, 3, 4).collect()}
        parts = {w: plain_parts(w, buckets, 3, 4) for w in WORDS}
        keys = sorted({b for p in parts.values() for b in p})
        a = np.array([[p.count(b) / len(p) for b in keys] for p in parts.values()])
        v, x = np.array([dict(rows)[w] for w in parts]), np.zeros((len(keys), 3))
        for _ in range(steps):
            x = x + (a.T @ (v - a @ x)) / a.sum(axis=0)[:, None]
        assert sorted(got) == keys and np.array([got[b] for b in keys]) == pytest.approx(x)
    table = tv.subword_vectors(df, 3, 3, 10**6, 3, 4)
    asked = spark.createDataFrame([("walked",), ("walk",), ("naïve",), ("talking",), ("q",), (None,), ("zzzz",)], "word string")
    made = {r.word: r.vector for r in tv.compose(asked, table, 3, 10**6, 3, 4).collect()}
    # a word whose n-grams no other one has is met at once
    assert made["naïve"] == pytest.approx(dict(rows)["naïve"]) and made["walked"] != made["walk"]
    assert any(made["talking"]) and made["zzzz"] == [0.0] * 3 and set(made) == {"walked", "walk", "naïve", "talking", "q", "zzzz"}
    assert tv.subword_vectors(df.limit(0), 3, 1).collect() == []


def test_gradient():
    g = np.random.default_rng(1)
    words, others, n, v = g.normal(size=(5, 4)), g.normal(size=(7, 4)), np.array([1.0, 2, 1, 3, 1]), g.normal(size=4)
    _, slope = tv.loss(v, n, words, others, 5.0)
    for i in range(4):
        e = np.eye(4)[i] * 1e-6
        assert slope[i] == pytest.approx((tv.loss(v + e, n, words, others, 5.0)[0] - tv.loss(v - e, n, words, others, 5.0)[0]) / 2e-6, rel=1e-5)


def test_paragraph_vectors(spark):
    g = np.random.default_rng(2)
    vocabulary = [f"a{i}" for i in range(10)] + [f"b{i}" for i in range(10)]
    vectors = {w: (np.array([1.0, 0, 0]) if w[0] == "a" else np.array([0, 1.0, 0])) + 0.1 * g.normal(size=3) for w in vocabulary}
    words = spark.createDataFrame([(w, v.tolist(), 1 + i) for i, (w, v) in enumerate(vectors.items())] + [("none", None, 1)], "word string, vector array<double>, n long")
    others = tv.common_words(words, 12)
    assert others.count() == 12 and {r.word for r in others.collect()} == {r.word for r in tv.common_words(words.repartition(4), 12).collect()}
    texts = {1: "a1 a2 a3 a3", 2: "b1 b2 b9", 3: "a5 a6 unknown", 4: None, 5: "unknown", 6: "a1 a2 a3 a3"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: np.array(r.vector) for r in tv.paragraph_vectors(docs, words, others, steps=15).collect()}
    assert set(got) == {1, 2, 3, 6} and (got[1] == got[6]).all()
    far = np.array([vectors[r.word] for r in others.orderBy("word").collect()])
    for d, own in ((1, ["a1", "a2", "a3", "a3"]), (2, ["b1", "b2", "b9"])):
        v = np.zeros(3)
        for _ in range(15):
            step = sum((1 - 1 / (1 + math.exp(-(vectors[w] @ v)))) * vectors[w] for w in own) / len(own)
            v = v + step - 5 / len(far) * sum(u / (1 + math.exp(-(u @ v))) for u in far)
        assert got[d] == pytest.approx(v)

    def cos(x, y):
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y)

    assert cos(got[1], got[3]) > cos(got[1], got[2])

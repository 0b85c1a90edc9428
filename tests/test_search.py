"""The stored index, exact neighbours and unseen labels against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import nearest, retrieval, text_index, zero_shot
from tesserae.plans.durable import shared_path


def grouped_texts(g, n=600):
    """Documents of ten subjects with words of their own and some common ones."""
    own = [[f"s{s}w{i}" for i in range(30)] for s in range(10)]
    common = [f"c{i}" for i in range(40)]
    return [(i, f"subject{i % 10}", " ".join(g.choices(own[i % 10], k=g.randint(0, 40)) + g.choices(common, k=g.randint(0, 30)))) for i in range(n)] + [(n, "subject0", None), (n + 1, "subject1", ""), (n + 2, None, "c1 S1W1, c1")]


def brute_bm25(docs, queries, k, k1=1.2, b=0.75):
    texts = {i: [w for w in (t or "").lower().replace(",", " ").split()] for i, _, t in docs}
    mean = sum(map(len, texts.values())) / len(texts)
    df = Counter(w for t in texts.values() for w in set(t))
    out = {}
    for q, text in queries:
        scores = defaultdict(float)
        for w, qf in Counter((text or "").lower().split()).items():
            for i, t in texts.items():
                if tf := t.count(w):
                    scores[i] += qf * math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / mean))
        for i, s in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]:
            out[q, i] = s
    return out


@pytest.mark.parametrize("k,probe,run", [(5, 2, 16), (7, 1, 32), (1000, 4, 16)])
def test_index(spark, k, probe, run):
    docs = grouped_texts(random.Random(1))
    queries = [(1, "s3w1 s3w2 s3w4"), (2, "c1 s5w9 s5w1 s5w2"), (3, "nothing known"), (4, None), (5, "c1 c1 c7"), (6, "s0w1 s7w3")]
    df = spark.createDataFrame(docs, "doc_id long, subject string, text string").repartition(5)
    index = text_index.write(df, shared_path(spark, "index"), ["subject"], run=run, buckets=8)
    qs = spark.createDataFrame(queries, "query_id long, query string")
    got = {(r.query_id, r.doc_id): r.score for r in index.search(qs, k, probe).collect()}
    assert got == pytest.approx(brute_bm25(docs, queries, k))
    assert got == pytest.approx({(r.query_id, r.doc_id): r.score for r in retrieval.top_k(retrieval.bm25(df, qs).withColumn("score", F.round("score", 9)), k).collect()}, abs=1e-8)
    work = {r.query_id: (r.runs, r.read) for r in index.search(qs, k, probe, work=True).collect()}
    assert set(work) == {1, 2, 5, 6} and all(b <= a for a, b in work.values())
    if k == 5:
        assert work[2][1] < work[2][0] / 4, work
    assert index.count() == len(docs)
    words = spark.createDataFrame([("c1",), ("s3w1",), ("unknown",), ("c1",)], "term string")
    assert {r.term: r.df for r in index.frequencies(words).collect()} == {w: sum(w in (t or "").lower().replace(",", " ").split() for _, _, t in docs) for w in ("c1", "s3w1")}


def test_index_reads_directories_of_its_terms_only(spark):
    df = spark.createDataFrame(grouped_texts(random.Random(2)), "doc_id long, subject string, text string")
    index = text_index.write(df, shared_path(spark, "index"), buckets=16, run=64)
    wanted = spark.createDataFrame([("c1",)], "term string").select("term", index._bucket())
    bucket = index._asked(wanted)
    table = index._table("postings", bucket)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(bucket#" in plan or "PartitionFilters: [(bucket#" in plan
    assert all(f"bucket={bucket[0]}/" in f for f in table.inputFiles()) or len(table.inputFiles()) >= 1
    assert len(bucket) == 1 and [r.bucket for r in table.select("bucket").distinct().collect()] == bucket
    with pytest.raises(ValueError):
        text_index.write(df, shared_path(spark, "index"), run=100)


def test_index_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    index = text_index.write(df, shared_path(spark, "index"))
    assert index.count() == 0 and index.search(spark.createDataFrame([(1, "a")], "query_id long, query string"), 3).collect() == []


def brute_neighbours(rows, k):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v is not None and len(v) and np.all(np.isfinite(np.array(v, float))) and np.any(v)}
    out = {}
    for i, a in unit.items():
        others = sorted(((-round(float(a @ b), 10), j) for j, b in unit.items() if j != i))[:k]
        out[i] = [(j, round(-s, 8)) for s, j in others]
    return out


@pytest.mark.parametrize("block,pivots", [(16, 4), (64, 1), (1024, None), (8, 12)])
def test_nearest_others(spark, block, pivots):
    g = np.random.default_rng(3)
    centres = g.normal(size=(6, 5))
    rows = [(i, (centres[i % 6] * 10 + g.normal(size=5)).round(3).tolist()) for i in range(240)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(70)]  # a hot vector
    rows += [(2000, [1.0, 2.0, 3.0, 4.0, 5.5]), (2001, [1.0, 2.0, 3.0, 4.0, 5.5]), (2002, None), (2003, [0.0] * 5), (2004, [float("nan")] + [1.0] * 4)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    got = nearest.neighbours(df, "id", 3, block=block, pivots=pivots, digits=10)
    found = defaultdict(list)
    for r in got.result.orderBy("id", F.desc(F.round("score", 10)), "other").collect():
        found[r.id].append((r.other, round(r.score, 8)))
        assert r.top_similarity >= r.score - 1e-12
    assert dict(found) == {i: [(j, pytest.approx(s, abs=1e-7)) for j, s in n] for i, n in brute_neighbours([r for r in rows if r[0] not in (2002, 2004)], 3).items()}
    work = got.work.first()
    assert work.classes == 242 and work.met <= work.block_pairs
    if pivots == 12:
        assert work.compared < 242 * 241 / 2 / 2, work


def test_nearest_others_of_few_rows(spark):
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    assert nearest.neighbours(empty, "id", 2).result.collect() == []
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    assert nearest.neighbours(one, "id", 2).result.collect() == []
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    assert sorted((r.id, r.other, round(r.score, 9)) for r in nearest.neighbours(two, "id", 2).result.collect()) == [(1, 2, 0.0), (2, 1, 0.0)]


def test_unseen_labels(spark):
    g = np.random.default_rng(4)
    w = g.normal(size=(6, 4))
    labels = [(f"l{i}", g.normal(size=4).tolist()) for i in range(20)]
    x = g.normal(size=(300, 6))
    y = x @ w + 0.01 * g.normal(size=(300, 4))
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*rows, (900, None, [1.0] * 4), (901, [1.0] * 6, None)], "doc_id long, x array<double>, y array<double>").repartition(4)
    weights = zero_shot.fit(df, ridge=0.5)
    assert weights == pytest.approx(np.linalg.solve(x.T @ x + 0.5 * np.eye(6), x.T @ y))
    names = spark.createDataFrame([*labels, ("zero", [0.0] * 4), ("null", None)], "label string, y array<double>")
    z = np.array([v for _, v in labels])
    z = z / np.linalg.norm(z, axis=1, keepdims=True)
    p = x @ weights
    scores = p / np.linalg.norm(p, axis=1, keepdims=True) @ z.T
    for most in (1 << 26, 64):
        got = zero_shot.match(df.where("doc_id < 900"), weights, names, 3, most_bytes=most).collect()
        assert len(got) == 900
        for r in got:
            order = sorted(range(20), key=lambda j: (-scores[r.doc_id, j], labels[j][0]))
            assert r.label == labels[order[r.place - 1]][0] and r.score == pytest.approx(scores[r.doc_id, order[r.place - 1]])
    made = {r.doc_id: r.predicted for r in zero_shot.predict(df, weights).collect()}
    assert made[900] is None and made[7] == pytest.approx(p[7].tolist())
    assert zero_shot.fit(df.limit(0)).size == 0 and zero_shot.match(df, weights, names.limit(0), 3).collect() == []

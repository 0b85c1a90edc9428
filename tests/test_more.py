"""Operators against plain versions of them."""

import itertools

import numpy as np
import pytest

from tesserae import schemas
from tesserae.operators import code, embedding, metrics, ranks, relational, retrieval, sampling, stats
from tesserae.sources import files


def test_sample_repos_by_own_lists(spark):
    df = spark.createDataFrame([("r1", ["a"]), ("r2", ["a", "b"]), ("r3", ["a", "b", "c"])], "repo string, tasks array<string>")
    tasks = spark.createDataFrame([("a",), ("b",)], "task string")
    assert {r.repo for r in sampling.sample_repos(df, tasks, 10, 2).collect()} == {"r2", "r3"}
    assert sampling.sample_repos(df, tasks.where("task = 'b'"), 1, 1).count() == 1
    assert sampling.sample_repos(df, tasks.limit(0), 10).count() == 0


def test_import_order_and_aliases():
    """By module, name and alias; a later plain import takes an alias's name back."""
    edges = [(s, t) for s, t, k in code.analyse("from a import z\nimport a.b\nfrom a import c as d, c\n").edges("r", "p") if k == "file-import"]
    assert edges == [("p", "a.c"), ("p", "a.c"), ("p", "a.z"), ("p", "a.b")]
    calls = [t for _, t, k in code.analyse("import x as np\nimport np\ndef f(): np.load()\n").edges("r", "p") if k == "function-function"]
    assert calls == ["np.load"]


def test_legacy_calls_by_their_rules():
    src = (
        "def f():\n    x = g(h(1), a.b)\n    return skipped()\n"
        "if True:\n    def inner():\n        while t():\n            k.m()\n        for i in r():\n            try:\n                z()\n            except E:\n                no()\n"
        "class C:\n    y = build() + other()\n    def method(self):\n        hidden()\n"
        "def f():\n    last()\n"
    )
    got = {}
    for c in code._legacy_calls(src):
        got.setdefault(c["source"], []).append(c["target"])
    assert got == {"f": ["last"], "inner": ["m", "r", "t", "z"], "C": ["build", "other"]}
    assert [c["target"] for c in code._legacy_calls("def f():\n    x = g(h(1), a.b)\n")] == ["b", "g", "h"]


def test_ranks_and_quantiles(spark):
    r = np.random.default_rng(0)
    rows = [(["a", "b", None][r.integers(3)], float(x)) for x in r.choice([*range(40), 0.5, 7.25], 400)] + [("a", None), ("lone", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {x.k: x.quantiles for x in ranks.quantiles(df, "v", [0, 0.1, 0.5, 0.99, 1], ["k"]).collect()}
    for k in ("a", "b", None, "lone"):
        own = [v for x, v in rows if x == k and v is not None]
        assert np.allclose(got[k], np.quantile(own, [0, 0.1, 0.5, 0.99, 1]))
    (whole,) = ranks.quantiles(df, "v", [0.25]).collect()
    assert np.isclose(whole.quantiles[0], np.quantile([v for _, v in rows if v is not None], 0.25))
    ranked = ranks.with_rank(df, "v", "rank", nulls=True).collect()
    values = [x.v if x.v is not None else -np.inf for x in ranked]
    assert all(x.rank == sum(v < w for v in values) + (sum(v == w for v in values) + 1) / 2 for x, w in zip(ranked, values))
    assert ranks.quantiles(df.limit(0), "v", [0.5], ["k"]).count() == 0


def test_permutation_test(spark):
    """Against the exact distribution of a small group, and a group without one side."""
    a, b = [1.0, 2.0, 2.0, 9.0], [2.0, 3.0, 5.0]
    df = spark.createDataFrame([("k", "a", v) for v in a] + [("k", "b", v) for v in b] + [("one", "a", 1.0)], "k string, g string, v double")
    got = {r.k: r for r in stats.permutation_test(df, "v", "g", "a", "b", ["k"], rounds=4000, parts=3).collect()}
    every = [*a, *b]
    seen = np.mean(a) - np.mean(b)
    hits = [np.mean([every[i] for i in c]) - np.mean([every[i] for i in range(7) if i not in c]) >= seen - 1e-12 for c in itertools.combinations(range(7), 4)]
    assert abs(got["k"].difference - seen) < 1e-12 and abs(got["k"].p - np.mean(hits)) < 0.03
    assert np.isnan(got["one"].difference)


def slow_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def slow_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_sequences_of_words(spark):
    r = np.random.default_rng(1)
    rows = [(i, " ".join(r.choice(list("abcde"), r.integers(0, 90))), " ".join(r.choice(list("abcdf"), r.integers(0, 90)))) for i in range(60)]
    got = {x.repo: x for x in metrics.generation_metrics(spark.createDataFrame(rows, "repo long, reference string, generated string")).collect()}
    for i, x, y in rows:
        a, b = x.split(), y.split()
        n = slow_common(a, b)
        assert abs(got[i].rougeL - (2 * n / (len(a) + len(b)) if n else 0)) < 1e-12 and got[i].edit_word == slow_edits(a, b)
        assert len(metrics._common(*metrics._numbers(a, b))) == n


def test_dense_ties_and_blocks(spark):
    r = np.random.default_rng(2)
    rows = [(f"d{i:03}", [float(x) for x in r.integers(-1, 2, 4)]) for i in range(300)]
    rows = [(k, v) for k, v in rows if any(v)] + [("none", None)]
    d = spark.createDataFrame(rows, "doc_id string, embedding array<double>").repartition(4)
    q = spark.createDataFrame([(i, [float(x) for x in r.integers(-1, 2, 4) + 0.5]) for i in range(20)], "query_id long, embedding array<double>")
    for most in (1 << 20, 100):
        got = {}
        for x in retrieval.dense(d, q, 7, normalise=False, most_bytes=most).collect():
            got.setdefault(x.query_id, []).append((-x.score, x.doc_id))
        for x in q.collect():
            want = sorted((-sum(a * b for a, b in zip(x.embedding, v)), k) for k, v in rows if v)[:7]
            assert sorted(got[x.query_id]) == want


def test_co_occurring_blocks(spark):
    df = spark.createDataFrame([(i, ["hot", f"t{i % 7}"]) for i in range(60)] + [(60, []), (61, ["t0", "t0"])], "repo long, tasks array<string>")
    want = sorted((a, b) for a, b in itertools.combinations(range(62), 2) if a < 60 and (b < 60 or a % 7 == 0 and b == 61))
    for block in (256, 7):
        assert sorted(map(tuple, relational.co_occurring_pairs(df, "repo", "tasks", block).collect())) == want


def test_feather_folder(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "if(id % 3 = 0, null, concat('x', id)) s", "array(id, 2) l").repartition(5)
    files.write(df, f"{tmp_path}/f.feather")
    assert sorted(map(tuple, files.read(spark, f"{tmp_path}/f.feather").collect()), key=lambda r: r[0]) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    files.write(df.limit(0), f"{tmp_path}/f.feather")
    back = files.read(spark, f"{tmp_path}/f.feather")
    assert back.count() == 0 and back.columns == df.columns
    with pytest.raises(FileExistsError):
        files.write(df, f"{tmp_path}/f.feather", mode="error")


def test_classifiers(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + r.normal(size=500) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    c = {r.feature: r.coefficient for r in stats.logistic_regression(df, ["a", "b"], "y").collect()}
    p = 1 / (1 + np.exp(-(c["a"] * x[:, 0] + c["b"] * x[:, 1] + c["intercept"])))
    assert abs((y - p).sum()) < 0.5 and abs(((y - p)[:, None] * x).sum(axis=0)).max() < 0.5
    scored = stats.random_forest(df, ["a", "b"], "y")
    (auc,) = stats.roc_area(scored, "probability", "y").first()
    assert 0.8 < auc <= 1 and scored.columns == ["a", "b", "y", "probability"]
    s = np.round(x[:, 0], 1)
    (auc,) = stats.roc_area(spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int"), "s", "y").first()
    assert abs(auc - np.mean([(u > v) + (u == v) / 2 for u in s[y == 1] for v in s[y == 0]])) < 1e-9


def test_walks_and_late_interaction(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "source string, target string")
    got = embedding.walks(e, per_node=3, length=4).collect()
    assert len(got) == 9 and all(w.path[0] == w.node and all((x, y) in {("a", "b"), ("b", "c"), ("a", "c")} for x, y in zip(w.path, w.path[1:])) for w in got)
    r = np.random.default_rng(4)
    d = [(i, [[float(x) for x in r.normal(size=3)] for _ in range(r.integers(0, 4))]) for i in range(30)]
    q = [(i, [[float(x) for x in r.normal(size=3)] for _ in range(r.integers(1, 4))]) for i in range(4)]
    kind = "vectors array<array<double>>"
    got = {(x.query_id, x.doc_id): x.score for x in retrieval.late_interaction(spark.createDataFrame(d, f"doc_id long, {kind}"), spark.createDataFrame(q, f"query_id long, {kind}"), 5).collect()}
    for i, qs in q:
        want = sorted(((-sum(max(np.dot(u, v) for v in vs) for u in qs), k) for k, vs in d if vs))[:5]
        assert all(abs(got[i, k] + s) < 1e-9 for s, k in want)


def test_files_that_lack_columns(spark, tmp_path):
    files.write(spark.createDataFrame([(1, "a")], "x long, y string"), f"{tmp_path}/a.feather")
    files.write(spark.createDataFrame([(2, 0.5), (None, 1.5)], "x long, z double"), f"{tmp_path}/b.feather")
    got = files.read_all(spark, [f"{tmp_path}/a.feather", f"{tmp_path}/b.feather"], ["x"]).select("x", "y", "z").orderBy("x").collect()
    assert [tuple(r) for r in got] == [(1, "a", None), (2, None, 0.5)]
    assert schemas.require(spark.createDataFrame([(1, "a")], "x long, y string"), "x long").count() == 1

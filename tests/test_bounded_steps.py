"""Steps whose cost once grew faster than their input."""

import collections
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tesserae import more_queries
from tesserae.operators import embedding, graph, nearest, relational, retrieval, sampling, text_index
from tesserae.plans.durable import shared_path, steps
from tesserae.sources import files


def test_sample_pipeline_makes_its_repos_once(spark):
    passes = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            passes.add(len(f))
            yield f

    plain = spark.range(300).select(F.col("id").alias("repo"), F.array(F.concat(F.lit("a"), F.col("id") % 7), F.concat(F.lit("b"), F.col("id") % 5)).alias("tasks"))
    repos = plain.mapInPandas(counted, "repo long, tasks array<string>")
    got = sampling.sample_pipeline(repos, plain.select("repo"), least_repos=3, per_task=5, most_per_task=100, most_random=0.99)
    assert got.count() == sampling.sample_pipeline(plain, plain.select("repo"), least_repos=3, per_task=5, most_per_task=100, most_random=0.99).count() > 0
    assert passes.value == 300


def test_blocks_of_two_groups_meet_in_one_task(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(12, 50, 4))
    x /= np.linalg.norm(x, axis=2, keepdims=True)
    blocks = pa.table({"block": list(range(12)), "ids": [[100 * b + i for i in range(50)] for b in range(12)], "vectors": [v.tobytes() for v in x], "bound": [[2.0] * 50] * 12})
    meetings = pa.table({"pairs": [[{"x_block": a, "y_block": b} for a in range(12) for b in range(a, 12)]]})
    got = nearest._meet(3)(blocks, meetings)
    # k neighbours for a row, however many blocks its own meets
    assert got.num_rows == 3 * 600 + 1 and got["compared"].to_pylist()[-1] == 600 * 599 // 2
    flat, ids = x.reshape(600, 4), np.array([100 * (i // 50) + i % 50 for i in range(600)])
    scores = flat @ flat.T
    np.fill_diagonal(scores, -2)
    want = {(int(ids[i]), int(ids[j])) for i in range(600) for j in np.argsort(-scores[i])[:3]}
    assert {(a, b) for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist()) if a is not None} == want


def test_search_sums_scores_where_postings_lie(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.concat(F.lit("b"), F.col("id") % 9)).alias("text"))
    queries = spark.createDataFrame([(1, "a b3"), (2, "b4 b5")], "query_id long, query string")
    with steps(spark) as step:
        index = text_index.write(docs, shared_path(spark, "index"), run=16, buckets=4)
        weights, most, buckets, n = index._bounded(queries, step)
        scores = index._scores(weights, most.select("query_id", "run"), buckets, n)
        plan = scores._jdf.queryExecution().executedPlan().toString()
        # runs are dealt, pairs of a query and a document aren't
        assert "(run#" in plan and not any("doc_id" in line for line in plan.splitlines() if "Exchange" in line)
        assert scores.where("query_id = 1").count() == 300


def test_co_occurring_pairs_are_dealt_by_their_number(spark, monkeypatch):
    df = spark.range(40).select(F.col("id").alias("k"), F.array(F.col("id") % 4, F.col("id") % 10 + 100).alias("l"))
    want = sorted((a, b) for a in range(40) for b in range(a + 1, 40) if a % 4 == b % 4 or a % 10 == b % 10)
    monkeypatch.setattr(relational, "MET_ROWS", 10)
    # 4 items of 10 keys and 10 of 4
    got = relational.co_occurring_pairs(df, "k", "l")
    # 4 * 50 + 10 * 8 pairs
    assert re.search(r"hashpartitioning\(_i#\d+L?, _x#\d+, _y#\d+, 28\)", got._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, got.collect())) == want


def test_global_rank_steps_only_over_inner_edges(spark, monkeypatch):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("x", "y"), ("z", "b"), ("w", "c"), ("w", "y")]
    names = sorted({n for r in rows for n in r})
    out = {n: sum(r[0] == n for r in rows) for n in names}
    written = {}

    class Kept(graph.Steps):
        def __call__(self, df, tag="step"):
            got = super().__call__(df, tag)
            written[tag] = got.count()
            return got

    monkeypatch.setattr(graph, "Steps", Kept)
    for article in (False, True):
        extra = len(rows) / len(names) if article else 0
        x = dict.fromkeys(names, 1 / len(names))
        for _ in range(6):
            loose = 0 if article else sum(x[n] for n in names if not out[n])
            x = {n: 0.85 * (sum(x[s] / (out[s] + extra) for s, t in rows if t == n) + loose / len(names)) + 0.15 / len(names) for n in names}
        got = {r.node: r.rank for r in graph.pagerank_global(spark.createDataFrame(rows, "source string, target string"), steps=6, tolerance=0, article=article).collect()}
        assert set(got) == set(names) and max(abs(got[n] - x[n]) for n in names) < 1e-12
    assert written["inner-pairs"] == 3 and written["ranks"] == 4


def test_scores_of_many_queries_come_in_small_products(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    queries = docs.select(F.col("doc_id").alias("query_id"), "embedding").unionAll(docs.select(F.col("doc_id") + 2000, "embedding")).toArrow()
    plain = retrieval._products(True)

    def prepare(vectors):
        score = plain(vectors)

        def small(column):
            assert len(vectors) * len(column) <= 1 << 20
            return score(column)

        return small

    assert retrieval._search(docs.repartition(1), queries, 1, prepare).where("query_id % 2000 = doc_id").count() == 4000


def test_feather_files_are_of_bounded_size(spark, tmp_path):
    df = spark.range(48).select("id", F.repeat(F.lit("x"), 1_000_000).alias("text")).repartition(1)
    files.write(df, f"{tmp_path}/f.feather")
    sizes = [os.path.getsize(f"{tmp_path}/f.feather/{n}") for n in os.listdir(f"{tmp_path}/f.feather")]
    assert len(sizes) >= 3 and max(sizes) < 18 << 20
    assert files.read(spark, f"{tmp_path}/f.feather").agg(F.count_distinct("id"), F.sum(F.length("text"))).first()[:] == (48, 48_000_000)


def _records_shuffled(spark) -> int:
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    store = sc.statusStore()
    stages = store.stageList(None, *(getattr(store, f"stageList$default${i}")() for i in range(2, 6)))
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_means_have_a_row_for_a_piece_of_a_vector(spark):
    rows = [(i, [float(i * j) for j in range(20)]) for i in range(300)]
    odd = [(300, None), (301, []), (302, [1.0, None]), (302, [3.0, None, 8.0]), (302, None), (None, [2.0]), (303, [None] * 9), (304, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows + odd, "g long, embedding array<double>").repartition(2)
    before = _records_shuffled(spark)
    got = {r.g: r.embedding for r in retrieval.mean_vector(df, ["g"]).collect()}
    # the rows, and at most 3 pieces of each, twice
    assert 300 < _records_shuffled(spark) - before <= 7 * len(rows + odd)
    nan = got.pop(304)
    assert math.isnan(nan[0]) and nan[1] == 1.0
    assert got == dict(rows) | {302: [2.0, None, 8.0], None: [2.0], 303: [None] * 9}


def test_embedded_texts_in_bounded_tasks(spark, monkeypatch):
    parts, plain = [], embedding.Word2Vec
    monkeypatch.setattr(embedding, "Word2Vec", lambda **options: parts.append(options["numPartitions"]) or plain(**options))
    monkeypatch.setattr(embedding, "TASK_WORDS", 150)
    monkeypatch.setattr(relational, "TASK_ROWS", 50)
    got = more_queries.e2_embedded_texts(spark, "/root/testdata/sf0.001")
    # 200 names of two words
    assert parts == [3] and re.search(r"hashpartitioning\(p_partkey#\d+L?, 8\), REPARTITION_BY_NUM", got._jdf.queryExecution().executedPlan().toString())
    assert {(r.words, r["size"], r.gap) for r in got.collect()} == {(2, 8, 0.0)} and got.count() == 200


def test_task_table_makes_its_papers_once(spark):
    g = random.Random(3)
    names = ["A-b", "a b", "12dC", "C", "D", "3D", "e", None, "rare"]
    rows = [(f"t{i}", [g.choice(names[:8]) for _ in range(g.randint(0, 5))]) for i in range(120)]
    rows += [("t3", ["D", "e", "D"]), (None, ["D"]), ("t4", None), ("t200", ["rare"]), ("t5", ["rare", "C"])]
    pairs = [(f"t{g.randint(0, 130)}", g.randint(0, 39)) for _ in range(150)] + [("t1", None), ("t2", 50), ("t2", 51), (None, 52), ("t200", 53)]
    passes = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            passes.add(len(f))
            yield f

    papers = spark.createDataFrame(rows, "title string, tasks array<string>").mapInPandas(counted, "title string, tasks array<string>")
    got = sampling.task_table(papers, spark.createDataFrame(pairs, "paper_title string, repo long"), 5)

    def clean(name):
        return re.sub(r"\d+d", "", name).replace("-", " ").lower().strip()

    counts = collections.Counter(clean(x) for _, l in rows for x in l or [] if x is not None)
    lists = collections.defaultdict(list)
    for title, l in rows:
        lists[title] += [(i, clean(x)) for i, x in enumerate(l or []) if x is not None and counts[clean(x)] >= 5]
    best = {}
    for title, repo in pairs:
        if title is not None and repo is not None and lists.get(title):
            best[repo] = min(best.get(repo, (0, "")), (-len(lists[title]), title))
    tasks = {repo: [x for _, x in sorted(lists[title])] for repo, (_, title) in best.items()}
    often = {x for x, n in collections.Counter(x for l in tasks.values() for x in l).items() if n > 5}
    first = {repo: next(x for x in l if x in often) for repo, l in tasks.items() if often & set(l)}
    assert sorted((r.repo, r.tasks, r.least_common_task) for r in got.collect()) == sorted((repo, [x for x in tasks[repo] if x in first.values()], x) for repo, x in first.items()) and len(first) > 30
    assert passes.value == len(rows)

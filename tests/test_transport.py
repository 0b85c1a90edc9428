"""Word mover's distance and token matching against plain versions; paged sources; fills and offsets over whole tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import embedding, metrics, relational, stats, transport
from tesserae.sources import paged


def test_transport_is_the_best_assignment():
    g = np.random.default_rng(0)
    for n in (1, 2, 3, 5, 6):
        for _ in range(8):
            cost = g.random((n, n)).round(1)
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))) / n
            assert transport.transport(cost, np.full(n, 1 / n), np.full(n, 1 / n)) == pytest.approx(best)


def test_transport_in_one_dimension():
    g = np.random.default_rng(1)
    for n, m in ((1, 7), (9, 4), (30, 30), (40, 25)):
        x, y, a, b = g.random(n).round(2), g.random(m).round(2), g.random(n), g.random(m)
        a, b = a / a.sum(), b / b.sum()
        at = np.sort(np.concatenate([x, y]))
        want = sum(abs(a[x <= p].sum() - b[y <= p].sum()) * (q - p) for p, q in zip(at, at[1:]))
        assert transport.transport(np.abs(x[:, None] - y), a, b) == pytest.approx(want)


WORDS = {"cat": [0.0, 1.0], "dog": [0.2, 1.0], "car": [3.0, 0.0], "bus": [3.5, 0.5], "zero": [0.0, 0.0]}


def test_word_mover(spark):
    pairs = [(1, "cat dog", "dog cat"), (2, "cat cat car", "bus dog"), (3, "cat", "unknown"), (4, None, "cat"), (5, "", ""), (6, "cat car", "bus dog dog"), (7, "cat", "dog"), (7, "cat", "dog")]
    df = spark.createDataFrame(pairs, "id long, a string, b string").repartition(3)
    vectors = spark.createDataFrame(list(WORDS.items()), "word string, vector array<double>")
    got = transport.word_mover(df, "a", "b", vectors).collect()
    assert len(got) == 8
    by = {r.id: (r.wmd, r.wmd_bound) for r in got}
    assert by[1] == pytest.approx((0, 0), abs=1e-7) and by[3] == by[4] == by[5] == (None, None)

    def d(x, y):
        return float(np.linalg.norm(np.subtract(WORDS[x], WORDS[y])))

    # 2/3 cat and 1/3 car against 1/2 bus and 1/2 dog: dog takes 1/2 cat, bus the rest
    assert by[2][0] == pytest.approx(d("cat", "dog") / 2 + d("cat", "bus") / 6 + d("car", "bus") / 3)
    assert by[7][0] == pytest.approx(0.2) and all(b[1] <= b[0] + 1e-12 for b in by.values() if b[0] is not None)
    cut = {r.id: (r.wmd, r.wmd_bound) for r in transport.word_mover(df, "a", "b", vectors, most=0.3).collect()}
    assert cut[2][0] is None and cut[2][1] == pytest.approx(by[2][1]) and cut[7] == pytest.approx(by[7])


def test_token_match_and_evaluation(spark):
    vectors = spark.createDataFrame(list(WORDS.items()), "word string, vector array<double>")
    df = spark.createDataFrame([("r1", 0, "cat dog dog", "car cat"), ("r1", 1, "zero", "cat"), ("r2", 0, "bus", "bus")], "repo string, generation int, reference string, generated string")
    got = {(r.repo, r.generation): r for r in metrics.run_evaluation(df, vectors).collect()}

    def cos(x, y):
        x, y = np.array(WORDS[x]), np.array(WORDS[y])
        return float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))

    r = got["r1", 0]
    p = (max(cos("car", w) for w in ("cat", "dog")) + cos("cat", "cat")) / 2
    c = (cos("cat", "cat") + 2 * max(cos("dog", w) for w in ("car", "cat"))) / 3
    assert (r.bertscore_precision, r.bertscore_recall, r.bertscore_f1) == pytest.approx((p, c, 2 * p * c / (p + c)))
    assert got["r1", 1].bertscore_f1 is None and got["r2", 0].bertscore_f1 == pytest.approx(1.0)
    order = [x.rougeL for x in metrics.run_evaluation(df).collect()]
    assert order == sorted(order, reverse=True)


def flaky(total=25, always=None):
    """A server of some items that fails every other time it is asked for a page."""
    asked = {}

    def fetch(options, page, per_page):
        n = asked[page] = asked.get(page, 0) + 1
        if n % 2 or page == always:
            raise OSError("try again")
        return [{"name": f"item{i}", "n": i, "topics": ["a", str(i)]} for i in range((page - 1) * per_page, min(page * per_page, total))]

    return fetch


def test_paged_source(spark):
    spark.dataSource.register(paged.paged_source("flaky", "name string, n long, topics string", flaky()))
    rows = spark.read.format("flaky").options(pages=10, per_page=4, pages_a_task=3, wait=0).load()
    assert rows.rdd.getNumPartitions() == 4
    got = sorted((r.n, r.name, r.topics) for r in rows.collect())
    assert got == [(i, f"item{i}", f'["a", "{i}"]') for i in range(25)]
    assert spark.read.format("flaky").options(pages=2, per_page=4, wait=0).load().count() == 8
    spark.dataSource.register(paged.paged_source("nothing", "name string", flaky(0)))
    with pytest.raises(Exception, match="no rows on the first page"):
        spark.read.format("nothing").options(wait=0).load().collect()
    spark.dataSource.register(paged.paged_source("broken", "name string", flaky(25, always=2)))
    with pytest.raises(Exception, match="try again"):
        spark.read.format("broken").options(per_page=4, wait=0, tries=2).load().collect()


def test_whole_table_fills_and_offsets(spark):
    g = random.Random(4)
    rows = [(i, g.choice([None, None, g.random()]), ["x"] * g.randint(0, 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v double, items array<string>").repartition(5)
    last, filled, start, before = None, {}, {}, 0
    for i, v, items in rows:
        last = v if v is not None else last
        filled[i], start[i] = last, before
        before += len(items)
    assert {r.id: r.v for r in relational.forward_fill(df, "v", "id").collect()} == filled
    assert {r.id: r.start for r in embedding.batch_offsets(df, "items", "id").collect()} == start


def test_chi_square_counts_empty_cells(spark):
    rows = [("a", "x")] * 5 + [("a", "y")] * 3 + [("b", "y")] * 7 + [("c", "x")] * 2 + [(None, "x")]
    got = stats.chi_square(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    o = np.array([[5, 3], [0, 7], [2, 0]], float)
    e = np.outer(o.sum(axis=1), o.sum(axis=0)) / o.sum()
    assert got.chi2 == pytest.approx(((o - e) ** 2 / e).sum()) and got.dof == 2
    a, b = (spark.createDataFrame([(v,) for v in x], "v double").select(F.col("v")) for x in ([1.0, 2.0, 6.0], [1.0, 3.0]))
    by = {r.statistic: r for r in stats.compare_describes(a, b, "v").collect()}
    assert by["mean"].difference == 1.0 and by["mean"].relative == pytest.approx(1 / 3)

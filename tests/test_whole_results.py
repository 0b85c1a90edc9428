"""Results that once were cut, failed or came out otherwise than their SQL."""

import collections
import math
import random

import duckdb
from pyspark.sql import functions as F

from tesserae import search_queries
from tesserae.operators import code, distances, ranks, relational, retrieval, sampling
from tesserae.queries import QUERIES, SQL, Tables
from tesserae.sources import files


def test_paged_source_reads_tables_of_several_files(spark, tmp_path):
    rows = spark.range(0, 1050, 1, 3).select("id", F.concat(F.lit("http://x/"), "id").alias("url"))
    # ids that come twice or are null are rows too
    rows.select(F.when(F.col("id") % 10 < 9, F.floor(F.col("id") / 2)).alias("page_id"), "url", F.lit("").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["s8_paged_source"](spark, str(tmp_path))
    assert sorted(r.url for r in got.collect()) == sorted(f"http://x/{i}" for i in range(1050))
    fetch = search_queries._pages_of(spark.read.parquet(f"{tmp_path}/pages.parquet"), 100)
    assert [len(fetch({}, p, 100)) for p in (1, 10, 11)] == [100, 100, 50]


def test_csv_keeps_every_text(spark, tmp_path):
    g = random.Random(3)
    texts = [None, "", " ", "\n", *("".join(g.choice('ab ,"\\\n\r\t\0\u00e9') for _ in range(g.randint(1, 6))) for _ in range(2000))]
    rows = {(i, t, texts[-i]) for i, t in enumerate(texts)}
    path = f"{tmp_path}/t.csv"
    files.write(spark.createDataFrame(list(rows), "id long, a string, b string"), path)
    assert {tuple(r) for r in files.read(spark, path, "id long, a string, b string").collect()} == rows


def test_means_are_added_up_in_order(spark):
    g = random.Random(5)
    rows = [(u, i, round(g.expovariate(0.02), 2)) for i in range(20_000) for u in (i % 25,)] + [(30, 1, None), (31, 2, None), (31, 1, 0.5), (None, 1, 1.5)]
    want = {}
    for u, _, v in sorted(rows, key=lambda r: r[1]):
        s, n, k = want.get(u, (None, 0, 0))
        want[u] = (s, n, k + 1) if v is None else ((s or 0.0) + v, n + 1, k + 1)
    df = spark.createDataFrame(g.sample(rows, len(rows)), "u long, i long, v double").repartition(7)
    got = relational.mean_in_order(df, ["u"], "v", ["i"])
    assert {r.u: (r["mean"], r.n) for r in got.collect()} == {u: (s / n if n else None, k) for u, (s, n, k) in want.items()}


def test_borda_of_means_between_two_rounded_ones(spark, tmp_path):
    # means of eight cents are often between two thousandths, and the order of the sum decides; a table this small DuckDB adds up from the first row to the last
    g = random.Random(8)
    events = [(i, g.randrange(900), g.randrange(9) / 100 + 0.01) for i in range(7200)]
    path = f"{tmp_path}/events.parquet"
    duckdb.sql("CREATE TEMP TABLE events (event_id BIGINT, user_id BIGINT, value DOUBLE)")
    try:
        duckdb.executemany("INSERT INTO events VALUES (?, ?, ?)", events)
        want = sorted(duckdb.sql(SQL["w12_borda"]).fetchall())
    finally:
        duckdb.sql("DROP TABLE events")
    spark.createDataFrame(g.sample(events, len(events)), "event_id long, user_id long, value double").repartition(5).write.parquet(path)
    assert sorted(map(tuple, QUERIES["w12_borda"](spark, str(tmp_path)).collect())) == want


def test_described_edges_name_all_targets(spark):
    edges = spark.range(1500).select(F.lit("r").alias("source"), F.format_string("f%04d", "id").alias("destination"), F.lit("repo-file").alias("edge_type"), F.lit("r").alias("repo"))
    assert code.postprocess_edges(edges, described=True).first().description.split() == [f"f{i:04d}" for i in range(1500)]
    assert len(code.postprocess_edges(edges, described=True, most=10).first().description.split()) == 10


def test_quantiles_to_the_last_bit(spark):
    g = random.Random(5)
    # in some groups all values are equal, so that the edges are values too
    rows = [(k, round(g.expovariate(0.02), 2)) for k in range(60) for _ in range(g.randint(2, 60))]
    rows += [(k, v) for k in range(60, 120) for v in [round(g.expovariate(0.02), 2)] for _ in range(g.randint(2, 60))]
    df = spark.createDataFrame(rows, "k int, v double")
    frame = df.toPandas()  # noqa: F841  DuckDB reads it
    at = [i / 10 for i in range(1, 10)]
    got = {r.k: r.quantiles for r in ranks.quantiles(df, "v", at, ["k"]).collect()}
    assert got == dict(duckdb.sql(f"SELECT k, quantile_cont(v, {at}) FROM frame GROUP BY 1").fetchall())
    one = df.where("k = 70")
    bins = duckdb.sql(f"WITH q AS (SELECT unnest(quantile_cont(v, {at})) AS e FROM frame WHERE k = 70) SELECT DISTINCT (SELECT count(*) FROM q WHERE e < v) FROM frame WHERE k = 70").fetchall()
    assert [tuple(r) for r in relational.quantile_bins(one, "v").select("bin").distinct().collect()] == bins
    odd = spark.createDataFrame([(1, float("inf")), (1, 1.0), (2, float("nan")), (2, 2.0), (3, None)], "k int, v double")
    assert {r.k: str(r.quantiles[0]) for r in ranks.quantiles(odd, "v", [0.5], ["k"]).collect()} == {1: "inf", 2: "nan"}


def test_matrix_by_classes_of_equal_neighbours(spark, tmp_path):
    g = random.Random(3)
    edges = [(f"h{g.randrange(8)}", f"h{g.randrange(8)}") for _ in range(9)] + [(f"l{i}", f"h{i % 3}") for i in range(120)] + [(f"d{i}", f"h{h}") for i in range(6) for h in (0, 1)]
    edges += [("x", "y"), ("o", "o"), (None, "h0"), ("z", None)]
    df = spark.createDataFrame(edges, "source string, target string")
    nodes = spark.createDataFrame(sorted((n,) for n in {n for e in edges[:-1] for n in e if n}), "node string")
    plain = {(r.source, r.node): r.distance for r in distances.shortest_paths(df, nodes).where("source <> 'z' AND node <> 'z'").collect()}
    whole = distances.matrix(df)
    # the leaves of a hub are one class
    assert whole.between.select("source").distinct().count() < 30
    whole.write(str(tmp_path / "m"))
    got = distances.Matrix.read(spark, str(tmp_path / "m")).rows([r.node for r in nodes.collect()])
    assert {(r.source, r.node): r.distance for r in got.collect()} == plain
    sums = {r.source: (r.nodes, r.total, r.farthest) for r in whole.totals().where("source <> 'z'").collect()}
    assert sums == {s: (len(d), sum(d), max(d)) for s in {k[0] for k in plain} for d in [[v for k, v in plain.items() if k[0] == s]]}


def test_products_are_summed_up_where_documents_are(spark):
    rows = [(d, f"t{(d * i) % 7}{i}", float(i)) for d in range(40) for i in range(6)]
    docs, queries = spark.createDataFrame(rows, "doc_id long, term string, weight double"), spark.createDataFrame(rows[:90], "query_id long, term string, weight double")
    got = retrieval.sparse_dot(docs, queries)
    assert "hashpartitioning(query_id" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for q, t, w in rows[:90]:
        for d, u, x in rows:
            if t == u:
                want[q, d] = want.get((q, d), 0) + w * x
    assert {(r.query_id, r.doc_id): r.score for r in got.collect()} == want


def test_repos_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(relational, "TASK_ROWS", 100)
    t = Tables(spark, "/root/testdata/sf0.001")
    repos = t.repos()
    assert repos.rdd.getNumPartitions() == -(-t.lineitem.count() // 100)
    # what is counted is sent, so repos stay where they lie
    plan = sampling.least_common_task(repos.withColumnRenamed("repo", "paper"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(task" not in plan and "SortMergeJoin" not in plan.replace("SortMergeJoin [paper", "").replace("SortMergeJoin [l_partkey", "")


def test_cosines_make_no_products_to_shuffle(spark, monkeypatch):
    g = random.Random(7)
    rows = [(f"g{i % 3}", i, " ".join(f"w{int(g.paretovariate(0.6))}" for _ in range(g.randint(0, 30)))) for i in range(150)] + [("g1", 200, None), (None, 201, "w1")]
    docs = spark.createDataFrame(rows, "grp string, doc_id long, text string")
    queries = docs.where("doc_id % 5 = 0").select("grp", F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    want = {}
    vectors = {}
    for grp in ("g0", "g1", "g2"):
        tf = {i: collections.Counter((t or "").split()) for p, i, t in rows if p == grp}
        df = collections.Counter(w for c in tf.values() for w in c)
        for i, c in tf.items():
            v = {w: n * (math.log((1 + len(tf)) / (1 + df[w])) + 1) for w, n in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            vectors[grp, i] = {w: x / norm for w, x in v.items()}
    for (p, q), a in vectors.items():
        for (r, d), b in vectors.items():
            if p == r and q % 5 == 0 and set(a) & set(b):
                want[p, q, d] = round(sum(a[w] * b[w] for w in set(a) & set(b)), 9)
    monkeypatch.setattr(retrieval, "DENSE_TERMS", 3)
    for size in (500, 1 << 26):  # many blocks of queries, and one
        got = retrieval.tfidf_cosine(docs, queries, most_bytes=size)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert {(r.grp, r.query_id, r.doc_id): round(r.score, 9) for r in got.collect()} == want


def test_cosines_shuffle_no_postings(spark):
    g = random.Random(9)
    rows = [(f"g{i % 2}", i, " ".join(g.sample([f"w{k}" for k in range(300)], 200))) for i in range(400)]
    docs = spark.createDataFrame(rows, "grp string, doc_id long, text string")
    queries = docs.where("doc_id % 50 = 0").select("grp", F.col("doc_id").alias("query_id"), F.col("text").alias("query"))

    def shuffled():
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    old = shuffled()
    assert retrieval.tfidf_cosine(docs, queries).count() == 8 * 200
    # before, 80,000 postings three times
    assert sum(n for stage, n in shuffled().items() if stage not in old) < 40_000


def test_cosines_of_odd_documents(spark, tmp_path):
    g = random.Random(10)
    rows = [(i % 170, " ".join(f"W{int(g.paretovariate(0.6))}" for _ in range(g.randint(0, 20))), f"s{i % 3}") for i in range(200)]
    rows += [(None, "W1 W2", "s1"), (None, "W1", "s1"), (50, "W1", None), (300, None, "s0"), (350, "", "s0"), (400, "W1", "s4")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = con.execute(SQL["r7_tfidf"]).fetchall()
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[:3]: r[3] for r in map(tuple, QUERIES["r7_tfidf"](spark, str(tmp_path)).collect())}
    assert got.keys() == {r[:3] for r in want} and all(abs(got[r[:3]] - r[3]) < 2e-6 for r in want)


def test_greedy_sample_brings_few_candidates_to_one_task(spark, monkeypatch):
    g = random.Random(11)
    repos = [(r, [f"t{int(g.paretovariate(0.7)) % 40}" for _ in range(g.randint(0, 5))]) for r in range(3000)] + [(4000, None), (4001, ["t1", None]), (4002, [None])]
    lists = [(r, sorted(set(ts or []), key=lambda t: (t is not None, t))) for r, ts in repos]
    counts = collections.Counter(t for _, ts in lists for t in ts if t is not None)
    given, want = collections.Counter(), set()
    for task in sorted((t for t, n in counts.items() if n >= 3), key=lambda t: (counts[t], t)):
        found = [(r, ts) for r, ts in lists if task in ts and all(given[t] <= 6 for t in ts)]
        for i, (r, ts) in enumerate(found[:4] if len(found) >= 3 else []):
            given.update(ts)
            want.add((task, r, i))
    brought, loop = spark.sparkContext.accumulator(0), sampling._loop

    def counting(*options):
        inner = loop(*options)

        def go(frames):
            def seen():
                for f in frames:
                    brought.add(len(f))
                    yield f

            yield from inner(seen())

        return go

    monkeypatch.setattr(sampling, "_loop", counting)
    monkeypatch.setattr(sampling, "SPARE", 2)
    got = sampling.greedy_sample(spark.createDataFrame(repos, "repo long, tasks array<string>"), 3, 4, 6)
    assert {tuple(r) for r in got.collect()} == want
    assert brought.value < sum(counts.values())

"""Cases worked out by hand, one for each rule that is easy to miss."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import schemas
from tesserae.functions import text as X
from tesserae.operators import code, distances, generation, graph, metrics, relational, retrieval, sampling, stats
from tesserae.plans import flows
from tesserae.sources import files


def edges_of(source):
    a = code.analyse(source)
    return None if a is None else [(s, t, k) for s, t, k in a.edges("r", "p.py")]


def of(source, kind):
    return [(s, t) for s, t, k in edges_of(source) if k == kind]


def test_no_edges_at_all_without_syntax():
    assert edges_of("def (") is None and edges_of(None) is None and edges_of("(" * 5000) is None
    assert edges_of("") == [("r", "p.py", "repo-file")]


def test_imports():
    src = "import numpy as np\ndef f(): np.array()"
    assert of(src, "file-import") == [("p.py", "numpy")] and of(src, "function-function") == [("f", "numpy.array")] and of(src, "import-import") == []
    assert of("import os\ndef f(): os.getcwd()", "import-import") == [("os", "os.getcwd")]
    assert of("from m import g\ndef f(): g()", "import-import") == [("m.g", "g")]
    assert of("from m import g as h\ndef f(): h()", "import-import") == []
    assert of("from . import t", "file-import") == [("p.py", "t")]


def test_scopes():
    nested = "def a():\n    def b(): pass"
    assert of(nested, "file-function") == [("p.py", "a")] and of(nested, "class-method") == [("a", "b")]
    c = "class C(B):\n    def m(self):\n        self.n()"
    assert of(c, "inheritance") == [("C", "B")] and of(c, "class-method") == [("C", "m")] and of(c, "function-function") == [("C.m", "n")]
    assert edges_of("async def f():\n    g()") == [("r", "p.py", "repo-file")]


def column(spark, f, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def test_selected_code(spark):
    got = column(spark, code.selected_code, ["x = 1\n", "# one\n", "# a\nx = 1\n# b\n", None])
    assert got == [None, "", "# a", None]
    assert code.matches("def f():\n    pass\n") == []
    assert [m["text"] for m in code.matches("# my class is:\n")] == ["class is:", "# my class is:"]


def test_signatures(spark):
    src = "import x\n@d\ndef f(a,\n      b):\n    return 1\n\nclass A:\n    x = 1\n"
    assert column(spark, code.signatures, [src]) == [["@d\ndef f(a,\n      b):", "class A:"]]
    assert column(spark, code.name_of_signature, ["def f(a)(b):", "class A:"]) == ["f(a)", "class A:"]


def test_module_and_token_lists(spark):
    assert column(spark, code.top_modules, ["import a.b, c\nfrom . import t\nfrom d.e import f", "def ("]) == [["a", "c", "d"], None]
    assert column(spark, code.name_tokens, ["def getHTTPResponse(my_value): return None"]) == [["get", "http", "none", "response", "value"]]


def test_legacy_edges(spark):
    df = spark.createDataFrame([("r", "a/x.py", "def foo():\n    bar()\n    f(g(x))\n")], schemas.PYTHON_FILES.replace("path string, content string, repo_name string", "repo_name string, path string, content string"))
    got = {(r.source, r.destination, r.edge_type) for r in code.legacy_edges(df).collect()}
    assert got == {("<ROOT>", "r", "root-repo"), ("r", "x", "repo-file"), ("x", "foo", "file-function"), ("foo", "bar", "function-function"), ("foo", "f", "function-function"), ("foo", "g", "function-function")}


def test_clean_task_name(spark):
    assert column(spark, X.clean_task_name, ["3d Object-Detection", "3D Pose", None]) == ["object detection", "3d pose", None]


def test_text_functions(spark):
    assert column(spark, X.split_identifier, ["snake_Case", "getHTTPResponse", "x"]) == [["snake", "case"], ["get", "http", "response"], ["x"]]
    assert column(spark, X.parse_list_literal, ["['a', 'b c']", '["it\'s"]', "[]", "no list", None]) == [["a", "b c"], ["it's"], [], None, None]
    assert column(spark, X.public_modules, [["a", "_b", "c"]], "array<string>") == ["a c"]
    assert column(spark, X.file_lines, ["a/b.py:\n  x\n c.py:\nnone"]) == [["a/b.py", "c.py"]]
    assert column(spark, X.clean_content, ["429: Too Many Requests", " x "]) == [None, "x"]
    assert column(spark, lambda c: X.highlight(c, ["a.b", "c"]), ["a.b axb c"]) == ["**a.b** axb **c**"]
    assert column(spark, lambda c: X.chunks(c, 3), ["abcdefg"]) == [["abc", "def", "g"]]
    assert column(spark, X.magnitude_bucket, [5.0, 50.0, 5e6], "double") == [0, 1, 2]
    assert column(spark, X.reciprocal, [0.0, 4.0], "double") == [math.inf, 0.25]
    assert column(spark, lambda c: X.sanitize_generated(c, F.lit("PROMPT")), ["PROMPT a], , b\n## rest"]) == ["a, b"]
    assert column(spark, X.retriever_label, ["bm25", "x/all-mpnet-base-v2", "a_b"]) == ["BM25", "MPNet", "a b"]
    assert column(spark, X.corpus_colour, ["dep_sig_x", "other"]) == ["blue", None]
    assert column(spark, lambda c: X.piece_after(c, "tags"), ["a tags b tags c"]) == [" c"]
    maps = spark.sql("select map('a', 1) x, map('a', 2, 'b', 3) y")
    assert maps.select(X.merge_first_wins([F.col("x"), F.col("y")]).alias("m")).first().m == {"a": 1, "b": 3}
    ok = spark.sql("select 1 x, cast(null as int) y").select(X.outcome(F.col("x")).alias("a"), X.outcome(F.col("y")).alias("b")).first()
    assert (ok.a.ok, ok.b.ok, ok.b.error) == (True, False, "no value")


def test_least_common_task(spark):
    df = spark.createDataFrame([("p", ["c", "a"]), ("q", ["c"]), ("r", ["a"]), ("s", ["c"])], "paper string, tasks array<string>")
    for compat, want in ((True, "c"), (False, "a")):
        assert {r.paper: r.least_common_task for r in sampling.least_common_task(df, 1, compat).collect()}["p"] == want


def test_hits_begin_at_one(spark):
    res = spark.createDataFrame([("q1", "a", 1.0), ("q2", "a", 1.0)], schemas.RESULTS)
    rel = spark.createDataFrame([("q1", "b", 1), ("q2", "c", 1)], schemas.QRELS)
    assert metrics.hits_at_k(res, rel, 1).first()[0] == 0.5 and metrics.hits_at_k(res, rel, 1, compat=False).first()[0] == 0
    assert {r["Hits@1"] for r in metrics.per_query(res, rel).collect()} == {0.0}


def brute_hybrid(a, b):
    def shares(d):
        s = sum(d.values())
        return sorted(((k, v / s) for k, v in d.items()), key=lambda x: (x[1], x[0]))

    x, y, out = shares(a), shares(b), {}
    while len(out) < max(len(a), len(b)):
        for items in (x, y):
            if items:
                k, v = items.pop()
                out[k] = v
    return out


def test_hybrid(spark):
    r = np.random.default_rng(1)
    cases = {"q0": ({"a": 2.0, "b": 1.0}, {"b": 3.0, "c": 1.0})}
    for i in range(1, 30):
        cases[f"q{i}"] = tuple({f"d{j}": float(r.integers(1, 6)) for j in r.choice(12, r.integers(1, 10), replace=False)} for _ in range(2))
    a, b = (spark.createDataFrame([(q, d, s) for q, c in cases.items() for d, s in c[i].items()], schemas.RESULTS) for i in (0, 1))
    got = {}
    for x in retrieval.hybrid(a, b).orderBy("position").collect():
        got.setdefault(x.query_id, []).append((x.doc_id, round(x.score, 9)))
    assert got == {q: [(k, round(v, 9)) for k, v in brute_hybrid(*c).items()] for q, c in cases.items()}
    assert [k for k, _ in got["q0"]] == ["a", "b"]


def test_samples(spark):
    assert column(spark, sampling.shake, ["a", None]) == ["867e2cb04f5a04dcbd592501a5e8fe9c", None]
    names = [f"t{i}" for i in range(40)]
    df = spark.createDataFrame([(n,) for n in names], "task string")
    want = sorted(names, key=lambda s: hashlib.shake_256(s.encode()).hexdigest(16))[:7]
    assert [r.task for r in sampling.deterministic_sample(df, "task", 7).collect()] == want
    p = spark.range(1).select(sampling.random_hit_probability(F.lit(100), F.lit(5)).alias("p"), sampling.random_hit_probability(F.lit(9), F.lit(5)).alias("q")).first()
    assert abs(p.p - 0.4162) < 1e-4 and p.q == 1


def brute_greedy(repos, least, per, most):
    counts = {}
    for ts in repos.values():
        for t in set(ts):
            counts[t] = counts.get(t, 0) + 1
    given, out = {}, []
    for t in sorted(counts, key=lambda t: (counts[t], t)):
        found = [r for r in sorted(repos) if t in repos[r] and all(given.get(x, 0) <= most for x in repos[r])]
        if len(found) >= least:
            for r in found[:per]:
                out.append((t, r))
                for x in set(repos[r]):
                    given[x] = given.get(x, 0) + 1
    return sorted(out)


def test_greedy_sample(spark):
    r = np.random.default_rng(3)
    repos = {f"r{i:03}": [f"t{j}" for j in r.choice(12, r.integers(1, 4), replace=False, p=np.arange(1, 13) / 78)] for i in range(150)}
    df = spark.createDataFrame(list(repos.items()), "repo string, tasks array<string>").repartition(4)
    for least, per, most in ((5, 4, 6), (10, 20, 8), (1, 2, 0)):
        got = sorted((x.task, x.repo) for x in sampling.greedy_sample(df, least, per, most).collect())
        assert got == brute_greedy(repos, least, per, most)


def test_few_shot_context(spark):
    df = spark.createDataFrame([(f"r{i}",) for i in range(9)], "repo string")
    got = sampling.few_shot_context(df, 4).collect()
    for i in range(9):
        own = [x.context for x in got if x.repo == f"r{i}"]
        assert len(own) == len(set(own)) == 4 and f"r{i}" not in own
    assert len(sampling.few_shot_context(df.limit(2), 4).collect()) == 2


def test_pagerank(spark):
    r = np.random.default_rng(0)
    rows = [("a", f"n{i}", f"n{j}", "x") for i, j in r.integers(0, 20, (45, 2))] + [("b", "s", "t", "x")]
    df = spark.createDataFrame(rows, "repo_name string, source string, target string, edge_type string")
    got = {(x.repo_name, x.node): x.centrality_score for x in graph.pagerank(df).collect()}
    names = sorted({n for k, s, t, _ in rows if k == "a" for n in (s, t)})
    m = np.zeros((len(names), len(names)))
    for k, s, t, _ in rows:
        if k == "a":
            m[names.index(t), names.index(s)] = 1
    out = m.sum(axis=0)
    m[:, out == 0], out[out == 0] = 1, len(names)
    x = np.full(len(names), 1 / len(names))
    for _ in range(200):
        x = 0.85 * (m / out) @ x + 0.15 / len(names)
    assert max(abs(got["a", n] - v) for n, v in zip(names, x)) < 1e-5
    assert abs(sum(v for (k, _), v in got.items() if k == "b") - 1) < 1e-9
    whole = {n.node: n.rank for n in graph.pagerank_global(df.where("repo_name = 'a'"), steps=30).collect()}
    assert max(abs(whole[n] - v) for n, v in zip(names, x)) < 1e-3


def test_signature_sections(spark):
    df = spark.createDataFrame([("r", "n1", 0.5, "repo-file", "repo-file,file-class", "source"), ("r", "n2", 0.4, "repo-file", "repo-file", "target")], schemas.CENTRALITIES)
    got = graph.dependency_signatures(df).first()
    assert got.dependency_signature == "repo: r\n\nrepo-file:\nn1, n2\n\nfile-class:\nn1"


def test_components_and_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "source string, target string")
    assert {r.node: r.component for r in graph.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    got = {(r.source, r.node): r.distance for r in distances.shortest_paths(e, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2}


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 5)] + [("b", float(v)) for v in (2, 6, 7, 8, 9)], "g string, v double")
    m = stats.mann_whitney(df, "v", "g", "a", "b").first()
    assert m.u == 2.0 and 0.04 < m.p < 0.08 and m.p_less < m.p
    assert abs(stats.kolmogorov_smirnov(df, "v", "g", "a", "b").first().d - 0.8) < 1e-9
    xy = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (5.0, 5.0)], "x double, y double")
    assert abs(stats.kendall(xy, "x", "y").first().tau - 0.6) < 1e-9 and abs(stats.spearman(xy, "x", "y").first().rho - 0.8) < 1e-9
    w = stats.wilcoxon(xy, "x", "y").first()
    assert (w.n, w.w) == (4, 5.0)
    p = stats.permutation_test(df.withColumn("k", F.lit("k")), "v", "g", "b", "a", ["k"], rounds=200).first()
    assert p.difference > 0 and p.p < 0.1
    assert relational.quantile_split(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10)], "v double"), "v", 0.1).count() == 1


def test_rouge(spark):
    df = spark.createDataFrame([("k", "the cat sat\non the mat", "the cat\nlay on the mat")], "repo string, reference string, generated string")
    r = metrics.generation_metrics(df).first()
    assert abs(r.rouge1 - 10 / 12) < 1e-9 and abs(r.rouge2 - 6 / 10) < 1e-9 and abs(r.rougeL - 10 / 12) < 1e-9 and r.edit_word == 1
    assert 0 < r.rougeLsum <= 1 and abs(r.jaccard_lst - 4 / 6) < 1e-9


def test_generation(spark):
    def picky(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "p string").coalesce(1)
    good, failed = generation.failures(generation.generate(df, "p", picky))
    assert {r.answer for r in good.collect()} == {"A", "C"} and [r.error for r in failed.collect()] == ["ValueError: no"]
    assert generation.generations(df, 3, "p").count() == 9


def test_files(spark, tmp_path):
    (tmp_path / "own_er_x" / "sub").mkdir(parents=True)
    (tmp_path / "own_er_x" / "sub" / "a.py").write_text("x = 1")
    (tmp_path / "own_er_x" / "b.py").write_text("")
    (tmp_path / "own_er_x" / "c.py").write_bytes(b"\xff\xfe")
    (r,) = files.python_directory(spark, f"file://{tmp_path}").collect()
    assert (r.repo_name, r.path, r.content) == ("own/er_x", "own_er_x/sub/a.py", "x = 1")
    with pytest.raises(ValueError):
        files.read(spark, "x.txt")
    with pytest.raises(ValueError, match="readme"):
        schemas.require(spark.range(1), schemas.REPOS)
    df = spark.createDataFrame([("a", "['t u', 'v']"), ("b", None)], "paper string, tasks string")
    for end in ("parquet", "csv", "jsonl"):
        files.write(df, f"{tmp_path}/t.{end}")
        assert files.papers(spark, f"{tmp_path}/t.{end}").collect()[0].tasks == ["t u", "v"]
    import pyarrow as pa
    import pyarrow.feather as feather

    feather.write_feather(pa.table({"x": [1, 2], "y": ["a", None]}), f"{tmp_path}/t.feather")
    assert sorted(tuple(r) for r in files.read(spark, f"{tmp_path}/t.feather").collect()) == [(1, "a"), (2, None)]
    (tmp_path / "map.json").write_text(json.dumps({"r": "text", "s": "more"}))
    assert {tuple(r) for r in files.repo_map(spark, f"{tmp_path}/map.json").collect()} == {("r", "text"), ("s", "more")}
    vec = spark.createDataFrame([("w", [0.5, 12345.123456])], "word string, vector array<double>")
    assert files.word_vectors(vec).first().value == "w 0.50000 12345.12346"
    assert files.table_text(spark.sql("select 'a_b' x, 1.5D y")) == "| x | y |\n| --- | --- |\n| a_b | 1.500 |"
    assert "a\\_b & 1.500" in files.table_text(spark.sql("select 'a_b' x, 1.5D y"), "latex")


def test_traces_and_searches(spark, tmp_path):
    rows = [("OK", "f", '{"a": 1}', '{"b": "x"}'), ("ERROR", "f", "{}", "{}"), ("OK", "g", "{}", "{}")]
    spark.createDataFrame(rows, "status_code string, name string, `attributes.input.value` string, `attributes.output.value` string").write.parquet(f"{tmp_path}/tr")
    assert [tuple(r) for r in files.generated_traces(spark, f"{tmp_path}/tr", "f", "a int", "b string").collect()] == [(1, "x")]
    raw = spark.sql("select array(named_struct('name', 'n', 'description', cast(null as string), 'topics', array('a', 'b')), named_struct('name', 'n', 'description', 'd', 'topics', array('c'))) items")
    assert [(r.name, r.description, r.topics) for r in files.search_results(raw).collect()] == [("n", "", "a b")]


def test_flows(spark):
    rows = [(f"s{i}.py", f"import os\nclass K{i}:\n    def m(self):\n        os.getcwd()\n", f"r{i % 3}") for i in range(6)]
    df = spark.createDataFrame(rows, schemas.PYTHON_FILES)
    sig = {r.repo: r.dependency_signature for r in flows.signatures_of_files(df).collect()}
    assert set(sig) == {"r0", "r1", "r2"} and sig["r0"].startswith("repo: r0\n\nrepo-file:\n") and "file-import:\n" in sig["r0"]
    corpus = spark.createDataFrame([("c", "d1", "d1", "red fox"), ("c", "d2", "d2", "blue sky"), ("e", "d1", "d1", "sky"), ("e", "d2", "d2", "fox")], schemas.CORPUS)
    q = spark.createDataFrame([("q", "fox")], schemas.QUERIES)
    rel = spark.createDataFrame([("q", "d1", 1)], schemas.QRELS)
    got = {r.corpus: r["Hits@1"] for r in flows.evaluate(corpus, q, rel, {"bm25": retrieval.bm25}).collect()}
    assert got == {"c": 1.0, "e": 0.0}


def test_stream(spark, tmp_path):
    from tesserae.streaming import events

    spark.sql("select 1L event_id, timestamp'2024-01-01 10:00' ts, 1L user_id, 'a' event_type, 2.0D value, '' props").write.parquet(f"{tmp_path}/e")
    stream = events.windowed(events.read(spark, f"{tmp_path}/e"), "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.event_type, r.n, r.total) for r in spark.table("windows").collect()] == [("a", 1, 2.0)]

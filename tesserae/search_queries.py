"""Registered queries of the stored index, neighbours, unseen labels, distances, node vectors, transport and paged sources, with their DuckDB SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import tokenize
from tesserae.operators import code, distances, embedding, metrics, nearest, relational, spectral, stats, text_index, text_vectors, transport, zero_shot
from tesserae.plans.durable import materialize, shared_path
from tesserae.queries import _LEGACY, _TERMS, query, tables
from tesserae.sources import files, paged

# the stored index


def _index(t) -> text_index.TextIndex:
    return text_index.write(t.documents.select("doc_id", "text", "lang", "source"), shared_path(t._spark, "index"), ["lang", "source"], run=256)


_BM25 = "WITH q AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest(" + _TERMS.format("text") + ") AS term FROM benchmark) GROUP BY 1, 2), b AS (SELECT doc_id, " + _TERMS.format("text") + " AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM b), tf AS (SELECT doc_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM b) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), r AS (SELECT query_id, doc_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY 1, 2)"


@query(_BM25 + " SELECT query_id, doc_id, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 50")
@tables
def r6_index_search(t):
    """The 50 best documents for each item of the benchmark, by an index that is written first."""
    qs = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _index(t).search(qs, 50).withColumn("score", F.round("score", 6))


@query(_BM25 + " SELECT term, df, (SELECT n FROM s) AS documents FROM df")
@tables
def k10_index_counts(t):
    """In how many of the indexed documents the benchmark's terms stand."""
    index = _index(t)
    words = t.benchmark.select(F.explode(index.tokens(F.col("text"))).alias("term"))
    return index.frequencies(words).withColumn("documents", F.lit(index.count()).cast("long"))


_UNIT = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings), u AS (SELECT vec_id, label, list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) AS d FROM v)"


@query(f"WITH {_UNIT}, s AS (SELECT a.vec_id AS vec_id, b.vec_id AS other, list_dot_product(a.d, b.d) AS score FROM u a, u b WHERE a.vec_id <> b.vec_id) SELECT vec_id, other, round(score, 6) AS score, round(max(score) OVER (PARTITION BY vec_id), 6) AS top_similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 12) DESC, other) <= 3")
@tables
def r9_nearest_others(t):
    """Cells by pivots; pairs of blocks that the triangle inequality settles are never met."""
    return nearest.neighbours(t.embeddings, "vec_id", 3).result.select("vec_id", "other", F.round("score", 6).alias("score"), F.round("top_similarity", 6).alias("top_similarity"))


# labels that training hasn't seen: a vector's first half is the text's, the mean second half of a label's rows is the label's; labels divisible by 3 aren't trained on

_HALF = "h AS (SELECT vec_id, label, list_transform(embedding[1:len(embedding) // 2], lambda v: v::DOUBLE) AS x, list_transform(embedding[len(embedding) // 2 + 1:len(embedding)], lambda v: v::DOUBLE) AS z FROM embeddings), lm AS (SELECT label, i, avg(z[i]) AS m FROM h, LATERAL unnest(range(1, len(z) + 1)) g(i) GROUP BY 1, 2), l AS (SELECT label, list(m ORDER BY i) AS y FROM lm GROUP BY 1)"
_NORMAL = f"""WITH RECURSIVE {_HALF},
t AS MATERIALIZED (SELECT list_concat(x, y) AS r, len(x) AS n FROM h JOIN l USING (label) WHERE label % 3 <> 0),
size AS (SELECT max(n) AS n FROM t),
g AS (SELECT i, j, sum(r[i] * r[j]) + max(CASE WHEN i = j THEN 1.0 ELSE 0.0 END) AS v FROM t, LATERAL unnest(range(1, n + 1)) a(i), LATERAL unnest(range(1, len(r) + 1)) b(j) GROUP BY 1, 2),
m0 AS (SELECT list(row ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS row FROM g GROUP BY i)),
elim(k, m) AS (SELECT 1, m FROM m0 UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k]) ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) FROM elim, size WHERE k <= n),
w AS MATERIALIZED (SELECT list_transform(m, lambda r: r[n + 1:]) AS w FROM elim, size WHERE k = n + 1),
p AS MATERIALIZED (SELECT vec_id, label AS own, list_transform(range(1, len(w[1]) + 1), lambda j: list_sum(list_transform(range(1, len(w) + 1), lambda i: x[i] * w[i][j]))) AS p FROM h, w WHERE label % 3 = 0),
s AS (SELECT vec_id, own, label, list_dot_product(p, y) / sqrt(list_dot_product(p, p) * list_dot_product(y, y)) AS score FROM p, l WHERE label % 3 = 0)
SELECT vec_id, label, own, round(score, 6) AS score, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS place FROM s) WHERE place <= 2"""


@query(_NORMAL)
@tables
def r14_unseen_labels(t):
    half = F.floor(F.size("embedding") / 2).cast("int")
    h = t.embeddings.select("vec_id", "label", F.slice("embedding", F.lit(1), half).alias("x"), F.slice("embedding", half + 1, F.size("embedding") - half).cast("array<double>").alias("z"))
    means = h.select("label", F.posexplode("z").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    labels = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("y"))
    unseen = F.col("label") % 3 == 0
    weights = zero_shot.fit(h.join(F.broadcast(labels), "label").where(~unseen))
    found = zero_shot.match(h.where(unseen), weights, labels.where(unseen), 2, "vec_id")
    return found.join(h.select("vec_id", F.col("label").alias("own")), "vec_id").select("vec_id", "label", "own", F.round("score", 6).alias("score"), "place")


# distances and node vectors: suppliers, nations and regions, which are all joined to each other

_GRAPH = "u AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || x.r_regionkey, 'r' || y.r_regionkey FROM region x, region y WHERE x.r_regionkey < y.r_regionkey), e AS MATERIALIZED (SELECT a, b FROM u UNION SELECT b, a FROM u)"


def _graph(t, suppliers: bool = True) -> DataFrame:
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    up = t.nation.select(key("n", "n_nationkey").alias("source"), key("r", "n_regionkey").alias("target"))
    x, y = (t.region.select(F.col("r_regionkey").alias(c)) for c in "xy")
    across = x.join(y, F.col("x") < F.col("y")).select(key("r", "x").alias("source"), key("r", "y").alias("target"))
    low = t.supplier.select(key("s", "s_suppkey").alias("source"), key("n", "s_nationkey").alias("target"))
    return up.unionByName(across).unionByName(low) if suppliers else up.unionByName(across)


_WALK = "w(source, node, distance) AS (SELECT DISTINCT a, a, 0 FROM e UNION SELECT source, e.b, distance + 1 FROM w JOIN e ON e.a = w.node WHERE distance < 5), d AS (SELECT source, node, min(distance)::INT AS distance FROM w GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {_GRAPH}, {_WALK} SELECT source, count(*) AS nodes, sum(distance)::BIGINT AS total, max(distance) AS farthest FROM d GROUP BY 1")
@tables
def g14_all_pairs(t):
    """Distances between all nodes, summed up by source."""
    return distances.matrix(_graph(t)).totals()


@query(f"WITH RECURSIVE {_GRAPH}, {_WALK} SELECT source, node, distance FROM d WHERE source IN ('r0', 'n3', 'n17')")
@tables
def k11_distance_matrix(t):
    """Rows of the stored matrix of all distances."""
    path = shared_path(t._spark, "matrix")
    distances.matrix(_graph(t)).write(path)
    return distances.Matrix.read(t._spark, path).rows(["r0", "n3", "n17"])


_NATIONS = "u AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION SELECT 'r' || x.r_regionkey, 'r' || y.r_regionkey FROM region x, region y WHERE x.r_regionkey < y.r_regionkey), e AS MATERIALIZED (SELECT a, b FROM u UNION SELECT b, a FROM u)"


@query(f"WITH RECURSIVE {_NATIONS}, {_WALK} SELECT x.source AS a, y.source AS b, round(sqrt(sum(pow(cosh(x.distance) - cosh(y.distance), 2))), 4) AS gap FROM d x JOIN d y ON x.node = y.node AND x.source < y.source GROUP BY 1, 2")
@tables
def g15_hyperbolic_gaps(t):
    """With a landmark for every node and all components, coordinates are as far apart as the rows of the full matrix."""
    found = distances.hyperbolic_coordinates(_graph(t, suppliers=False), 30, 256)
    x, y = (found.select(F.col("node").alias(c), F.col("components").alias(f"{c}_c")) for c in "ab")
    gap = F.sqrt(F.aggregate(F.zip_with("a_c", "b_c", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", F.round(gap, 4).alias("gap"))


@query(f"WITH {_GRAPH} SELECT a AS node, round(sqrt(count(*) / (SELECT count(*) FROM e)), 4) AS first FROM e GROUP BY 1")
@tables
def g16_spectral_vectors(t):
    """The first eigenvector of a connected graph's normalised adjacency matrix is the root of the degrees."""
    return spectral.spectral_vectors(_graph(t), 1, more=39, steps=6).select("node", F.round(F.col("vector")[0], 4).alias("first"))


def _smoothing(heat: float, order: int) -> str:
    import math

    steps = ["m AS MATERIALIZED (SELECT a, b, 1 / sqrt(x.d * y.d) AS w FROM e JOIN g x USING (a) JOIN (SELECT a AS b, d FROM g) y USING (b))", "t0 AS (SELECT a AS node, coalesce(s_acctbal / 1000, 0.0) AS x FROM g LEFT JOIN supplier ON a = 's' || s_suppkey)", "t1 AS (SELECT a AS node, sum(w * x) AS x FROM m JOIN t0 ON node = b GROUP BY 1)"]
    steps += [f"t{k} AS MATERIALIZED (SELECT p.node, 2 * p.x - q.x AS x FROM (SELECT a AS node, sum(w * x) AS x FROM m JOIN t{k - 1} ON node = b GROUP BY 1) p JOIN t{k - 2} q USING (node))" for k in range(2, order + 1)]
    total = " + ".join(f"{math.exp(-heat) * spectral._bessel(k, heat) * (1 if k == 0 else 2)!r} * t{k}.x" for k in range(order + 1))
    joins = " ".join(f"JOIN t{k} USING (node)" for k in range(1, order + 1))
    return f"WITH {_GRAPH}, g AS MATERIALIZED (SELECT a, count(*) AS d FROM e GROUP BY 1), {', '.join(steps)} SELECT node, round({total}, 6) AS value FROM t0 {joins}"


@query(_smoothing(0.7, 4))
@tables
def g16_smoothed_vectors(t):
    """Balances of suppliers, spread over the graph."""
    balances = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.array(F.col("s_acctbal") / 1000).alias("vector"))
    return spectral.smoothed(_graph(t), balances, 1, heat=0.7, order=4).select("node", F.round(F.col("vector")[0], 6).alias("value"))


# texts compared by the vectors of their words, which here are made of a word's length

_PAIRS = "w AS (SELECT item_id AS id, len(word) AS x, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda v: v <> '')) AS word FROM benchmark) GROUP BY 1, 2), p AS (SELECT id, x, n / sum(n) OVER (PARTITION BY id) AS w FROM w)"


def _neighbouring(t) -> tuple[DataFrame, DataFrame]:
    """Pairs of an item and the next one, and their words' vectors."""
    items = t.benchmark.select("item_id", F.col("text").alias("a"))
    pairs = items.join(t.benchmark.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("b")), "item_id")
    return pairs, t.benchmark.select(F.explode(tokenize(F.col("text"))).alias("word")).distinct()


@query(f"WITH {_PAIRS}, c AS (SELECT a.id, x, sum(s * w) AS g FROM (SELECT id, id AS own, 1 AS s FROM (SELECT DISTINCT id FROM p) UNION ALL SELECT id - 1, id, -1 FROM (SELECT DISTINCT id FROM p)) a JOIN p ON p.id = a.own GROUP BY 1, 2), r AS (SELECT id, abs(sum(g) OVER (PARTITION BY id ORDER BY x)) * (lead(x) OVER (PARTITION BY id ORDER BY x) - x) AS v FROM c) SELECT id AS item_id, round(sum(v), 6) AS wmd FROM r WHERE id IN (SELECT id FROM p) AND id + 1 IN (SELECT id FROM p) GROUP BY 1")
@tables
def m11_word_mover(t):
    """In one dimension transport is the area between the distributions."""
    pairs, words = _neighbouring(t)
    vectors = words.select("word", F.array(F.length("word").cast("double")).alias("vector"))
    return transport.word_mover(pairs, "a", "b", vectors).select("item_id", F.round("wmd", 6).alias("wmd"))


@query(f"WITH {_PAIRS}, s AS (SELECT a.id, a.x, a.w, b.x AS y, b.w AS v, (a.x * b.x + 1) / sqrt((a.x * a.x + 1.0) * (b.x * b.x + 1.0)) AS c FROM p a JOIN p b ON b.id = a.id + 1), r AS (SELECT id, sum(w * m) AS recall FROM (SELECT id, x, any_value(w) AS w, max(c) AS m FROM s GROUP BY 1, 2) GROUP BY 1), q AS (SELECT id, sum(v * m) AS precision FROM (SELECT id, y, any_value(v) AS v, max(c) AS m FROM s GROUP BY 1, 2) GROUP BY 1) SELECT id AS item_id, round(precision, 6) AS bertscore_precision, round(recall, 6) AS bertscore_recall, round(2 * precision * recall / (precision + recall), 6) AS bertscore_f1 FROM r JOIN q USING (id)")
@tables
def m10_run_evaluation(t):
    """Generated texts against references with all measures; here those from token vectors."""
    pairs, words = _neighbouring(t)
    vectors = words.select("word", F.array(F.length("word").cast("double"), F.lit(1.0)).alias("vector"))
    rows = pairs.select("item_id", F.lit(0).alias("generation"), F.col("a").alias("reference"), F.col("b").alias("generated"))
    got = metrics.run_evaluation(rows, vectors, "item_id")
    return got.select("item_id", *(F.round(f"bertscore_{c}", 6).alias(f"bertscore_{c}") for c in ("precision", "recall", "f1")))


# sources


#: Pages of a task of the paged source; the server below keeps as many in a folder.
_RUN = 64


def _pages_of(pages: DataFrame, per_page: int):
    """A server of a table's rows in the order of page_id, for the paged source. Spark numbers the rows and puts them, by run of pages, into the folder that all executors share, so a page costs the reading of its run."""
    kept = pages.select("page_id", "url").repartitionByRange("page_id").sortWithinPartitions("page_id")
    # an id's upper bits are the partition, its lower 33 the place there
    kept = materialize(kept.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), "rows")
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    paged_rows = kept.join(F.broadcast(before), "_part").select("page_id", "url", (F.floor(place / per_page) + 1).alias("page"), place.alias("place"))
    root = shared_path(pages.sparkSession, "pages")
    paged_rows.withColumn("run", F.floor((F.col("page") - 1) / _RUN)).repartition("run").sortWithinPartitions("run", "place").write.partitionBy("run").parquet(root)

    def fetch(options: dict, page: int, per_page: int) -> list:
        import pyarrow.parquet as pq

        return pq.read_table(f"{root}/run={(page - 1) // _RUN}", columns=["page_id", "url"], filters=[("page", "=", page)], partitioning=None).to_pylist()

    return fetch


@query("SELECT page_id, url FROM pages")
@tables
def s8_paged_source(t):
    """All rows of `pages`, page by page."""
    t._spark.dataSource.register(paged.paged_source("pages_by_page", "page_id long, url string", _pages_of(t.pages, 100)))
    return t._spark.read.format("pages_by_page").options(pages=-(-t.pages.count() // 100), per_page=100, pages_a_task=_RUN).load()


@query("SELECT 'r/' || s_nationkey AS repo_name, 'r_' || s_nationkey || '/src/s' || s_suppkey || '.py' AS path, md5('x = ' || s_suppkey || chr(10)) AS digest FROM supplier WHERE s_suppkey % 5 <> 0")
@tables
def s10_python_directory(t):
    """Files of suppliers, a fifth of them empty, beside such that aren't Python."""
    root = shared_path(t._spark, "directory")

    def write(batches):
        for frame in batches:
            for path, content in zip(frame["path"], frame["content"]):
                where = os.path.join(root.removeprefix("file://"), path)
                os.makedirs(os.path.dirname(where), exist_ok=True)
                with open(where, "w") as f:
                    f.write(content)
            yield frame[["path"]]

    name = F.concat(F.lit("r_"), F.col("s_nationkey").cast("string"), F.lit("/src/s"), F.col("s_suppkey").cast("string"))
    rows = t.supplier.select(name.alias("n"), F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("x = "), F.col("s_suppkey").cast("string"), F.lit("\n"))).otherwise(F.lit("")).alias("content"))
    rows = rows.select(F.explode(F.array(F.concat("n", F.lit(".py")), F.concat("n", F.lit(".txt")))).alias("path"), "content")
    rows.mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return files.python_directory(t._spark, root).select("repo_name", "path", F.md5("content").alias("digest"))


# statistics and training data

_DESCRIBE = " UNION ALL ".join(f"SELECT '{n}' AS statistic, {f} AS v, k FROM x GROUP BY k" for n, f in (("count", "count(q)::DOUBLE"), ("mean", "avg(q)"), ("std", "stddev_samp(q)"), ("min", "min(q)"), ("p25", "quantile_cont(q, 0.25)"), ("p50", "quantile_cont(q, 0.5)"), ("p75", "quantile_cont(q, 0.75)"), ("max", "max(q)")))


@query(f"WITH x AS (SELECT l_returnflag AS k, l_extendedprice AS q FROM lineitem WHERE l_returnflag IN ('A', 'R')), s AS ({_DESCRIBE}) SELECT a.statistic, round(a.v - b.v, 4) AS difference, round((a.v - b.v) / a.v, 6) AS relative FROM s a JOIN s b ON a.statistic = b.statistic AND a.k = 'A' AND b.k = 'R'")
@tables
def z12_compare_describes(t):
    a, b = (t.lineitem.where(F.col("l_returnflag") == k) for k in "AR")
    return stats.compare_describes(a, b, "l_extendedprice").select("statistic", F.round("difference", 4).alias("difference"), F.round("relative", 6).alias("relative"))


@query(f"WITH {_LEGACY}, f AS (SELECT repo, source AS file, string_agg(DISTINCT destination, ' ' ORDER BY destination) AS functions, count(DISTINCT destination) AS n FROM le WHERE edge_type = 'file-function' GROUP BY 1, 2) SELECT repo, file, functions, 't' || repo AS task FROM f QUALIFY sum(n) OVER (PARTITION BY repo) > 1")
@tables
def e10_repos_with_functions(t):
    """Files of repos with more than one function."""
    edges = code.legacy_edges(t.sources())
    repos = edges.where("edge_type = 'root-repo'").select(F.col("destination").alias("repo"), F.array(F.concat(F.lit("t"), "destination")).alias("tasks"))
    return embedding.file_dataset(edges, repos, least=1).select("repo", "file", F.array_join("functions", " ").alias("functions"), "task")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' OR event_id % 7 = 0 THEN value END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events")
@tables
def p9_fill_whole_table(t):
    sparse = t.events.withColumn("value", F.when((F.col("event_type") == "purchase") | (F.col("event_id") % 7 == 0), F.col("value")))
    return relational.forward_fill(sparse, "value", "event_id").select("event_id", "value")


# vectors of unseen words and of texts: a word's own vector is made of its length and its first letter's code

_VECTOR = "[len(word) / 10, ascii(word) / 1000]"
_ITEM_WORDS = "SELECT item_id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda v: v <> '')) AS word FROM benchmark"


def _vectors_of(words: DataFrame) -> DataFrame:
    return words.select("word", F.array(F.length("word") / 10.0, F.ascii("word") / 1000.0).alias("vector"))


def _subwords(steps: int, buckets: int) -> str:
    ctes = [
        f"w AS MATERIALIZED (SELECT DISTINCT word, unnest([1, 2]) AS i, unnest({_VECTOR}) AS v FROM (SELECT DISTINCT word FROM ({_ITEM_WORDS})))",
        "g AS (SELECT DISTINCT word, m[j : j + n - 1] AS g FROM (SELECT DISTINCT word, '<' || word || '>' AS m FROM w), (VALUES (3), (4)) t(n), LATERAL unnest(range(1, len(m) - n + 2)) u(j))",
        f"c AS (SELECT word, ('0x' || md5(g)[1:8])::BIGINT % {buckets} AS bucket, count(*) AS n FROM g GROUP BY 1, 2)",
        "p AS MATERIALIZED (SELECT word, bucket, n / sum(n) OVER (PARTITION BY word) AS share FROM c)",
        "t AS MATERIALIZED (SELECT bucket, sum(share) AS total FROM p GROUP BY 1)",
        "b0 AS (SELECT bucket, i, 0.0::DOUBLE AS b FROM t, (VALUES (1), (2)) k(i))",
    ]
    for k in range(steps):
        ctes += [f"m{k} AS MATERIALIZED (SELECT word, i, sum(share * b) AS x FROM p JOIN b{k} USING (bucket) GROUP BY 1, 2)", f"b{k + 1} AS MATERIALIZED (SELECT bucket, i, b + x / total AS b FROM b{k} JOIN (SELECT bucket, i, sum(share * (v - x)) AS x FROM p JOIN m{k} USING (word) JOIN w USING (word, i) GROUP BY 1, 2) USING (bucket, i) JOIN t USING (bucket))"]
    return f"WITH {', '.join(ctes)} SELECT word, round(max(CASE WHEN i = 1 THEN x END), 6) AS first, round(max(CASE WHEN i = 2 THEN x END), 6) AS second FROM (SELECT word, i, sum(share * b) AS x FROM p JOIN b{steps} USING (bucket) GROUP BY 1, 2) GROUP BY 1"


@query(_subwords(3, 4096))
@tables
def e3_subword_vectors(t):
    """Words put together again from the vectors of their n-grams."""
    words = t.benchmark.select(F.explode(tokenize(F.col("text"))).alias("word")).distinct()
    table = text_vectors.subword_vectors(_vectors_of(words), 2, 3, 4096, 3, 4)
    made = text_vectors.compose(words, table, 2, 4096, 3, 4)
    return made.select("word", *(F.round(F.col("vector")[i], 6).alias(c) for i, c in enumerate(("first", "second"))))


def _paragraphs(steps: int, most: int) -> str:
    sigma = "1 / (1 + exp(-(x * v.x0 + y * v.y0)))"
    ctes = [
        f"r AS MATERIALIZED (SELECT item_id, word, count(*) AS n FROM ({_ITEM_WORDS}) GROUP BY 1, 2)",
        f"w AS MATERIALIZED (SELECT word, {_VECTOR}[1] AS x, {_VECTOR}[2] AS y, ('0x' || md5('0:' || word)[1:8])::BIGINT / 4294967296.0 AS h FROM (SELECT DISTINCT word FROM r))",
        f"o AS MATERIALIZED (SELECT x, y, count(*) OVER () AS many FROM (SELECT * FROM w ORDER BY h, word LIMIT {most}))",
        "v0 AS (SELECT item_id, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0 FROM (SELECT DISTINCT item_id FROM r))",
    ]
    for k in range(steps):
        own = f"(SELECT item_id, sum(n * (1 - {sigma}) * x) / sum(n) AS ax, sum(n * (1 - {sigma}) * y) / sum(n) AS ay FROM r JOIN w USING (word) JOIN v{k} v USING (item_id) GROUP BY 1)"
        far = f"(SELECT item_id, sum(5 / many * {sigma} * x) AS bx, sum(5 / many * {sigma} * y) AS by_ FROM v{k} v, o GROUP BY 1)"
        ctes.append(f"v{k + 1} AS MATERIALIZED (SELECT item_id, x0 + ax - bx AS x0, y0 + ay - by_ AS y0 FROM v{k} JOIN {own} USING (item_id) JOIN {far} USING (item_id))")
    return f"WITH {', '.join(ctes)} SELECT item_id, round(x0, 6) AS first, round(y0, 6) AS second FROM v{steps}"


@query(_paragraphs(4, 32))
@tables
def e4_paragraph_vectors(t):
    """Vectors of the benchmark's texts, by steps against 32 other words."""
    words = _vectors_of(t.benchmark.select(F.explode(tokenize(F.col("text"))).alias("word")).distinct())
    docs = t.benchmark.select(F.col("item_id").alias("doc_id"), "text")
    found = text_vectors.paragraph_vectors(docs, words, text_vectors.common_words(words, 32), steps=4)
    return found.select(F.col("doc_id").alias("item_id"), *(F.round(F.col("vector")[i], 6).alias(c) for i, c in enumerate(("first", "second"))))

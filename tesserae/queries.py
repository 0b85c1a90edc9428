"""Registered queries of the pipeline's operators over the driver's tables, with the same in DuckDB's SQL where it can say it.

The tables hold no repositories, so they stand in: a repo is an order with the brands and brand/types of its parts as tasks; a file is a document (repo:
source) or a supplier's generated source text; edges are line items (repo: supplier, order -> part, type: return flag); events are metric
rows (query: user, retriever: event type). Floating results are rounded on both sides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.operators import code, embedding, generation, graph, metrics, ranks, relational, retrieval, sampling, stats
from tesserae.plans import flows
from tesserae.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")

    def repos(self) -> DataFrame:
        """repo, tasks"""
        lines = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("repo"), "p_brand", F.concat("p_brand", F.lit("/"), "p_type").alias("t"))
        lines = relational.dealt(lines, self.lineitem.count(), "repo")
        return lines.groupBy("repo").agg(F.collect_set("p_brand").alias("b"), F.collect_set("t").alias("t")).select("repo", F.array_sort(F.concat("b", "t")).alias("tasks"))

    def edges(self) -> DataFrame:
        c = F.col
        return self.lineitem.select(c("l_suppkey").alias("repo_name"), F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), c("l_returnflag").alias("edge_type"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("ordinal"))

    def sources(self) -> DataFrame:
        """repo_name, path, content: a Python file for each supplier, in turn one with a class, one with decorators, aliases and async code, and one that doesn't parse."""
        k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
        first = F.concat(F.lit("import os\nimport numpy as np\nfrom lib"), n, F.lit(" import helper\n# supplier "), k, F.lit("\nclass C"), k, F.lit("(Base):\n    def run(self):\n        self.step()\n        os.getcwd()\n\ndef f"), n, F.lit("(a):\n    return helper(np.load(a))\n"))
        second = F.concat(F.lit("from pkg"), n, F.lit(".mod import tool as t, other\nimport json\n\n\n@other\ndef g"), k, F.lit("(x, y=json.dumps({})):\n    # step\n    z = t(x) + other(y)\n    return z\n\nasync def h():\n    json.loads(z)\n"))
        kind = F.col("s_suppkey") % 3
        content = F.when(kind == 0, first).when(kind == 1, second).otherwise(F.lit("def broken(:\n"))
        return self.supplier.select(F.concat(F.lit("r"), n).alias("repo_name"), F.concat(F.lit("src/s"), k, F.lit(".py")).alias("path"), content.alias("content"))

    def results(self) -> DataFrame:
        """query_id, doc_id, score: orders' customers, parts, and prices"""
        return self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").cast("string").alias("query_id"), F.col("l_partkey").cast("string").alias("doc_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("score"))

    def qrels(self) -> DataFrame:
        return self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_returnflag = 'R'").select(F.col("o_custkey").cast("string").alias("query_id"), F.col("l_partkey").cast("string").alias("doc_id"), F.lit(1).alias("rel")).distinct()


def tables(f):
    def run(spark, sf_dir):
        return f(Tables(spark, sf_dir))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


RT = "rt AS (SELECT DISTINCT repo, task FROM (SELECT l_orderkey AS repo, unnest([p_brand, p_brand || '/' || p_type]) AS task FROM lineitem JOIN part ON l_partkey = p_partkey))"
TC = RT + ", tc AS (SELECT task, count(*) AS n FROM rt GROUP BY task)"
EDGES = "e AS (SELECT l_suppkey AS repo_name, 'o' || l_orderkey AS source, 'p' || l_partkey AS target, l_returnflag AS edge_type, l_orderkey * 8 + l_linenumber AS ordinal FROM lineitem)"
RES = "res AS (SELECT o_custkey::VARCHAR AS query_id, l_partkey::VARCHAR AS doc_id, round(sum(l_extendedprice), 2) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
REL = "rel AS (SELECT DISTINCT o_custkey::VARCHAR AS query_id, l_partkey::VARCHAR AS doc_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')"
RANKED = RES + ", " + REL + ", rk AS (SELECT res.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r, (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM rel) AS hit FROM res)"

# scans and filters


@query("SELECT count(*) AS n_files, count(DISTINCT source) AS n_repos, count(*) / count(DISTINCT source) AS mean_files FROM documents")
@tables
def s1_file_statistics(t):
    from tesserae.sources.files import file_statistics

    return file_statistics(t.documents.withColumnRenamed("source", "repo_name"))


@query("SELECT repo, n FROM (SELECT regexp_replace(source || '_' || lang, '^([^_]*)_', '\\1/') AS repo, count(*) AS n FROM documents GROUP BY 1)")
@tables
def s11_repo_of_path(t):
    from tesserae.sources.files import repo_of_path

    return t.documents.groupBy(repo_of_path(F.concat_ws("_", "source", "lang")).alias("repo")).agg(F.count("*").alias("n"))


@query("SELECT source, round(avg(len(string_split(text, chr(10)))), 6) AS mean_lines FROM documents GROUP BY source")
@tables
def s17_mean_lines(t):
    return t.documents.groupBy("source").agg(F.round(F.avg(X.line_count(F.col("text"))), 6).alias("mean_lines"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_returnflag = 'R' AND l_quantity < 10")
@tables
def p1_filter(t):
    return t.lineitem.where("l_shipdate >= timestamp '1996-01-01' AND l_returnflag = 'R' AND l_quantity < 10").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey FROM part WHERE NOT starts_with(p_brand, 'Brand#1')")
@tables
def p2_without_prefix(t):
    return relational.without_prefix(t.part, "p_brand", "Brand#1").select("p_partkey")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[Ll]icense[d ]')")
@tables
def p3_regex(t):
    return t.documents.where(F.col("text").rlike("[Ll]icense[d ]")).select("doc_id")


@query(f"WITH {RT} SELECT repo, count(*) AS n FROM rt GROUP BY repo HAVING count(*) BETWEEN 1 AND 10")
@tables
def p4_list_size(t):
    return relational.with_list_size(t.repos(), "tasks", 1, 10).select("repo", F.size("tasks").cast("long").alias("n"))


@query(f"WITH {RT} SELECT DISTINCT repo FROM rt WHERE task = 'Brand#23'")
@tables
def p5_list_member(t):
    return relational.with_member(t.repos(), "tasks", "Brand#23").select("repo")


@query(f"WITH {TC} SELECT DISTINCT repo FROM rt WHERE task IN (SELECT task FROM tc ORDER BY n DESC, task LIMIT 3)")
@tables
def p6_list_overlap(t):
    repos = t.repos()
    return relational.with_any(repos, "tasks", relational.top_values(repos, "tasks", 3), "task", "repo").select("repo")


@query(f"WITH {RT}, k AS (SELECT repo, string_agg(task, ' ' ORDER BY task) AS tasks FROM rt WHERE task IN (SELECT DISTINCT p_brand FROM part) GROUP BY repo) SELECT repo, coalesce(tasks, '') AS tasks FROM (SELECT DISTINCT repo FROM rt) LEFT JOIN k USING (repo)")
@tables
def p7_keep_members(t):
    kept = relational.keep_members(t.repos(), "tasks", t.part.select(F.col("p_brand").alias("task")).distinct(), "task", "repo")
    return kept.select("repo", F.array_join("tasks", " ").alias("tasks"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' OR event_id % 7 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events")
@tables
def p9_forward_fill(t):
    sparse = t.events.withColumn("value", F.when((F.col("event_type") == "purchase") | (F.col("event_id") % 7 == 0), F.col("value")))
    return relational.forward_fill(sparse, "value", "event_id", ["user_id"]).select("event_id", "value")


@query("SELECT s_suppkey, s_name || ' / ' || s_nationkey AS both FROM supplier")
@tables
def p11_concat_columns(t):
    return relational_concat(t.supplier)


def relational_concat(df: DataFrame) -> DataFrame:
    return X.concat_columns(df, ["s_name", "s_nationkey"], "both", " / ").select("s_suppkey", "both")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN (SELECT max(c_acctbal) FROM customer WHERE c_nationkey <> 3) ELSE c_acctbal END AS c_acctbal FROM customer")
@tables
def p15_clip_infinite(t):
    df = t.customer.withColumn("c_acctbal", F.when(F.col("c_nationkey") == 3, F.lit(float("inf"))).otherwise(F.col("c_acctbal")))
    return relational.clip_infinite(df, "c_acctbal").select("c_custkey", "c_acctbal")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents) WHERE r % 10 = 0 AND r < 100")
@tables
def p16_every_nth(t):
    return relational.every_nth(t.documents, F.col("doc_id"), 10, 10, ["source"]).select("doc_id")


# joins


@query("SELECT n.n_name, count(*) AS customers, count(s.s_suppkey) AS suppliers FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) s ON s.s_nationkey = n.n_nationkey GROUP BY 1")
@tables
def j1_inner(t):
    first = t.supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    j = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).join(first, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_name").agg(F.count("*").alias("customers"), F.count("s_suppkey").alias("suppliers"))


@query("SELECT a.k, a.name, b.name AS name_b, b.bal FROM (SELECT c_nationkey AS k, max(c_name) AS name FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS k, max(s_name) AS name, max(s_acctbal) AS bal FROM supplier GROUP BY 1) b USING (k)")
@tables
def j3_suffixed(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_name").alias("name"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_name").alias("name"), F.max("s_acctbal").alias("bal"))
    return relational.join_suffixed(a, b, "k", "_b")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k")
@tables
def j5_full_outer(t):
    a, b = (t.orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(n)) for s, n in (("F", "a"), ("O", "b")))
    return relational.side_by_side(a, b, "k").na.fill(0, ["a", "b"])


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
@tables
def j6_right_fill(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return n.join(t.customer.select("c_custkey"), "c_custkey", "right").na.fill(0, ["n"])


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
@tables
def j7_semi(t):
    keys = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return relational.filter_in([t.customer.select("c_custkey")], "c_custkey", keys)[0]


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
@tables
def j8_anti(t):
    return relational.except_keys(t.customer.select("c_custkey"), t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("WITH l AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS i FROM lineitem) SELECT DISTINCT x.k AS a, y.k AS b FROM l x JOIN l y ON x.i = y.i AND x.k < y.k")
@tables
def j9_co_occurring(t):
    lines = relational.dealt(t.lineitem.select("l_suppkey", "l_partkey"), t.lineitem.count(), "l_suppkey")
    lists = lines.groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("parts"))
    return relational.co_occurring_pairs(lists, "l_suppkey", "parts")


@query("WITH g AS (SELECT l_suppkey AS id, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT a.id, a.n AS n_A, b.n AS n_N, c.n AS n_R FROM g a JOIN g b ON a.id = b.id JOIN g c ON a.id = c.id WHERE a.f = 'A' AND b.f = 'N' AND c.f = 'R'")
@tables
def j10_stack_relations(t):
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("f")).agg(F.count("*").alias("n"))
    return relational.stack_relations(g, "id", "f", ["n"], ["A", "N", "R"])


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
@tables
def j11_papers_with_repos(t):
    links = t.orders.select("o_orderkey", "o_custkey")
    return relational.papers_with_repos(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"), links, "o_custkey")


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
@tables
def j13_enrich(t):
    out = relational.enrich(t.supplier.select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey")), t.nation, "n_nationkey", ["n_name"])
    return out.select("s_suppkey", "s_name", "n_name")


@query("WITH o AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_name) AS ord FROM nation) SELECT ord, s_suppkey FROM o JOIN supplier ON s_nationkey = n_nationkey")
@tables
def j15_align(t):
    from pyspark.sql import Window

    have = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    order = t.nation.withColumn("ord", F.row_number().over(Window.orderBy("n_name")).cast("long")).select("n_nationkey", "ord").join(have.select("n_nationkey"), "n_nationkey", "left_semi")
    return relational.align(t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey"), "n_nationkey", order).select("ord", "s_suppkey")


@query(f"WITH {RT}, a AS (SELECT p_brand || '/' || p_type AS task, min(p_size) AS area FROM part GROUP BY 1) SELECT repo, task, area FROM (SELECT repo, task, area, row_number() OVER (PARTITION BY repo ORDER BY task) AS r FROM rt JOIN a USING (task)) WHERE r = 1")
@tables
def j16_repo_dimension(t):
    areas = t.part.select(F.concat("p_brand", F.lit("/"), "p_type").alias("task"), F.col("p_size").alias("area"))
    return relational.repo_dimension(t.repos(), areas)


@query("SELECT c_custkey, n_orders, round(total, 2) AS total, first_date FROM customer JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY 1) USING (c_custkey) JOIN (SELECT o_custkey AS c_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) USING (c_custkey) JOIN (SELECT o_custkey AS c_custkey, min(o_orderdate) AS first_date FROM orders GROUP BY 1) USING (c_custkey)")
@tables
def j18_star(t):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey").groupBy("c_custkey")
    parts = [t.customer.select("c_custkey"), o.agg(F.count("*").alias("n_orders")), o.agg(F.round(F.sum("o_totalprice"), 2).alias("total")), o.agg(F.min("o_orderdate").alias("first_date"))]
    return relational.star(parts, "c_custkey")


# aggregates


@query(f"WITH {TC} SELECT task, n AS count FROM tc")
@tables
def a1_value_counts(t):
    return relational.value_counts(t.repos(), "tasks")


@query(f"WITH {TC} SELECT task, n AS count FROM tc ORDER BY n DESC, task LIMIT 20")
@tables
def a2_top_values(t):
    return relational.top_values(t.repos(), "tasks", 20)


@query(f"WITH {TC} SELECT task, n AS count FROM tc WHERE n > (SELECT count(DISTINCT repo) FROM rt) / 40")
@tables
def a3_frequent_values(t):
    repos = t.repos()
    n = repos.agg((F.count("*") / 40).alias("least"))
    return relational.value_counts(repos, "tasks").join(F.broadcast(n)).where("count > least").select("task", "count")


@query("SELECT conv_id, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
@tables
def a4_group_text(t):
    return relational.group_text(t.conversations, ["conv_id"], "text", ["turn"], "\n\n").select("conv_id", F.md5("text").alias("digest"))


@query("SELECT o_custkey, string_agg(DISTINCT p_brand, ' ' ORDER BY p_brand) AS brands FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
@tables
def a5_group_union(t):
    lists = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("brands"))
    joined = lists.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return relational.group_union(joined, ["o_custkey"], "brands").select("o_custkey", F.array_join("brands", " ").alias("brands"))


@query("SELECT l_suppkey, l_returnflag AS flag, md5(string_agg(l_orderkey::VARCHAR, ' ' ORDER BY l_orderkey)) AS orders FROM lineitem GROUP BY 1, 2")
@tables
def a6_group_map(t):
    m = relational.group_map(t.lineitem.select("l_suppkey", "l_returnflag", "l_orderkey", F.col("l_orderkey").alias("o")), ["l_suppkey"], "l_returnflag", "l_orderkey", "o")
    return m.select("l_suppkey", F.explode("map").alias("flag", "orders")).select("l_suppkey", "flag", F.md5(F.array_join(F.col("orders").cast("array<string>"), " ")).alias("orders"))


@query("SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS o_orderstatus, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS o_orderprioritys FROM orders GROUP BY 1")
@tables
def a7_merge_metadata(t):
    rows = t.orders.withColumn("tags", F.array("o_orderpriority"))
    m = relational.merge_metadata(rows, "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"], "tags")
    return m.select("o_custkey", *(F.array_join(c, ",").alias(c) for c in ("o_orderstatus", "o_orderprioritys")))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
@tables
def a8_argmax(t):
    return relational.first_of_group(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT event_type, round(avg(value), 6) AS value, round(avg(user_id), 6) AS user_id FROM events GROUP BY 1")
@tables
def a9_mean(t):
    return metrics.mean_by(t.events, ["event_type"], ["value", "user_id"]).select("event_type", F.round("value", 6).alias("value"), F.round("user_id", 6).alias("user_id"))


@query("SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max FROM events GROUP BY 1")
@tables
def a10_describe(t):
    d = relational.describe(t.events, "value", ["event_type"])
    return d.select("event_type", "count", *(F.round(c, 6).alias(c) for c in ("mean", "std")), "min", *(F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")), "max")


@query("SELECT o_custkey, round(avg(o_totalprice) + 1e-7, 2) AS mean, round(quantile_cont(o_totalprice::DOUBLE, 0.5) + 1e-7, 2) AS median, count(*) AS n FROM orders GROUP BY 1")
@tables
def a11_mixed(t):
    sums = t.orders.groupBy("o_custkey").agg(F.round(F.avg("o_totalprice") + 1e-7, 2).alias("mean"), F.count("*").alias("n"))
    middle = ranks.quantiles(t.orders, "o_totalprice", [0.5], ["o_custkey"])
    return ranks.beside(sums, middle, ["o_custkey"]).select("o_custkey", "mean", F.round(F.col("quantiles")[0] + 1e-7, 2).alias("median"), "n")


@query("SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
@tables
def a12_distinct_by(t):
    return relational.first_of_group(t.documents.select("source", "lang", "doc_id"), ["source", "lang"], [F.col("doc_id")])


@query("SELECT event_type, min(event_id) AS ord FROM events GROUP BY 1")
@tables
def a13_unique_in_order(t):
    return relational.unique_in_order(t.events, "event_type", "event_id")


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
@tables
def a14_count_distinct(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"))


@query("WITH u AS (SELECT DISTINCT l_suppkey AS repo_name, p_brand || '/' || p_type AS function_name, p_name AS function_signature FROM lineitem JOIN part ON p_partkey = l_partkey), c AS (SELECT *, count(*) OVER (PARTITION BY function_name) AS times FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY times, function_name, function_signature) AS rank FROM c) SELECT repo_name, string_agg(function_name, ' ' ORDER BY rank) AS names, md5(string_agg(function_signature, chr(10) || 'pass' || chr(10) ORDER BY rank)) AS digest FROM r WHERE rank <= 5 GROUP BY 1")
@tables
def a15_rarest_signatures(t):
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("repo_name"), F.lit("").alias("path"), F.concat("p_brand", F.lit("/"), "p_type").alias("function_name"), F.col("p_name").alias("function_signature"))
    return code.rarest_corpus(code.rarest_signatures(rows, 5)).select("repo_name", "names", F.md5("text").alias("digest"))


@query(f"WITH {TC} SELECT task, n AS count, round(sum(n) OVER (ORDER BY n DESC, task ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 9) AS share FROM tc")
@tables
def a17_cumulative_share(t):
    return relational.cumulative_share(relational.value_counts(t.repos(), "tasks"), "task").withColumn("share", F.round("share", 9))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
@tables
def a18_crosstab(t):
    return relational.crosstab(t.lineitem, "l_returnflag", "l_linestatus", ["F", "O"])


@query(f"WITH {EDGES} SELECT coalesce(a.node, b.node) AS node, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree, coalesce(o, 0) + coalesce(i, 0) AS degree FROM (SELECT source AS node, count(*) AS o FROM e GROUP BY 1) a FULL JOIN (SELECT target AS node, count(*) AS i FROM e GROUP BY 1) b ON a.node = b.node")
@tables
def a19_degrees(t):
    return relational.degrees(t.edges())


@query("WITH s AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(target), target) AS r FROM s) SELECT source, md5(string_agg(DISTINCT target, ' ' ORDER BY target)) AS digest FROM r WHERE r <= 1000 GROUP BY 1")
@tables
def a20_descriptions(t):
    e = t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    return relational.descriptions(e, 1000).select("source", F.md5("description").alias("digest"))


_IDS = EDGES + ", ids AS (SELECT node, row_number() OVER (ORDER BY substr(md5(node), 1, 3), node) - 1 AS id FROM (SELECT source AS node FROM e UNION SELECT target FROM e))"


@query(f"WITH {_IDS} SELECT DISTINCT s.id AS source_id, t.id AS target_id FROM e JOIN ids s ON s.node = e.source JOIN ids t ON t.node = e.target")
@tables
def a21_integer_ids(t):
    return relational.recode(t.edges())


# rankings


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5")
@tables
def w1_head(t):
    return relational.head(t.documents, ["source"], [F.col("doc_id")], 5).select("source", "doc_id")


@query(f"WITH {RANKED} SELECT query_id, coalesce(min(r) FILTER (WHERE hit) - 1, -1) AS position, count(*) FILTER (WHERE hit) AS num_recalled FROM rk GROUP BY 1")
@tables
def w8_first_hit(t):
    return metrics.recalled(t.results(), t.qrels()).select("query_id", F.col("position").cast("long").alias("position"), "num_recalled")


@query("SELECT event_id FROM events WHERE value <= (SELECT quantile_cont(value, 0.1) FROM events)")
@tables
def w9_quantile_split(t):
    return relational.quantile_split(t.events, "value", 0.1).select("event_id")


@query("WITH q AS (SELECT unnest(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM events) SELECT event_id, (SELECT count(*) FROM q WHERE e < value) AS bin FROM events")
@tables
def w10_quantile_bins(t):
    return relational.quantile_bins(t.events, "value").select("event_id", F.col("bin").cast("long").alias("bin"))


@query("WITH m AS (SELECT user_id, round(avg(value), 3) AS a, count(*) AS b FROM events GROUP BY 1) SELECT user_id, rank() OVER (ORDER BY a) - 1 + (count(*) OVER (PARTITION BY a) - 1) / 2 + rank() OVER (ORDER BY b) - 1 + (count(*) OVER (PARTITION BY b) - 1) / 2 AS borda FROM m")
@tables
def w12_borda(t):
    m = relational.mean_in_order(t.events, ["user_id"], "value", ["event_id"], "a", "b").withColumn("a", F.round("a", 3))
    return relational.borda(m, ["a", "b"]).select("user_id", "borda")


# sets


@query("SELECT k, sum(n)::BIGINT AS n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1) GROUP BY 1")
@tables
def u1_union(t):
    a, b = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    return relational.union_all([a, b]).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
@tables
def u2_union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
@tables
def u3_common_keys(t):
    return relational.common_keys([t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FOP"], "k")


@query(f"WITH {RES} SELECT query_id, doc_id, round(sum(score), 2) AS score FROM (SELECT * FROM res UNION ALL SELECT query_id, doc_id, 1.0 FROM res WHERE score > 50000 UNION ALL SELECT query_id, 'x', 2.0 FROM (SELECT DISTINCT query_id FROM res)) GROUP BY 1, 2")
@tables
def u7_merge_scores(t):
    res = t.results()
    other = res.where("score > 50000").select("query_id", "doc_id", F.lit(1.0).alias("score")).unionAll(res.select("query_id").distinct().select("query_id", F.lit("x"), F.lit(2.0)))
    return relational_merge(res, other)


def relational_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return relational.merge_scores(a, b).withColumn("score", F.round("score", 2))


# functions


@query("SELECT p_partkey, trim(lower(replace(regexp_replace('3d ' || p_type || '-' || p_size || 'D ', '[0-9]+d', '', 'g'), '-', ' '))) AS task FROM part")
@tables
def f1_clean_task_name(t):
    return t.part.select("p_partkey", X.clean_task_name(F.concat(F.lit("3d "), "p_type", F.lit("-"), "p_size", F.lit("D "))).alias("task"))


@query("SELECT p_partkey, trim(replace(replace(replace(replace(p_size || 'D ' || p_name, '2D', ''), '3D', ''), '4D', ''), '6D', '')) AS name FROM part")
@tables
def f3_strip_dimensions(t):
    return t.part.select("p_partkey", X.strip_dimensions(F.concat("p_size", F.lit("D "), "p_name")).alias("name"))


@query("SELECT doc_id, md5(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS digest, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS words FROM documents")
@tables
def f4_whitespace(t):
    return t.documents.select("doc_id", F.md5(X.collapse_whitespace(F.col("text"))).alias("digest"), X.word_count(F.col("text")).alias("words"))


@query("SELECT s_suppkey, 'get parse ' || lower(replace(replace(s_name, '#', ' '), ' ', '')) AS words FROM supplier")
@tables
def f6_split_identifier(t):
    name = F.concat(F.lit("get_parse_"), F.replace(F.replace("s_name", F.lit("#"), F.lit("")), F.lit(" "), F.lit("")))
    return t.supplier.select("s_suppkey", F.array_join(X.split_identifier(name), " ").alias("words"))


@query("SELECT conv_id, turn, split_part(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10), 1).replace('[', '').replace(']', '').replace(',', '').replace('''', '') AS line FROM conversations")
@tables
def f9_first_line(t):
    return t.conversations.select("conv_id", "turn", X.first_line_plain(F.col("text")).alias("line"))


@query("SELECT p_partkey, p_brand || '-' || p_size AS both FROM part")
@tables
def f13_list_literal(t):
    literal = F.concat(F.lit("['"), "p_brand", F.lit("', '"), F.col("p_size").cast("string"), F.lit("']"))
    return t.part.select("p_partkey", F.array_join(X.parse_list_literal(literal), "-").alias("both"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
@tables
def f14_json(t):
    return t.events.select("event_id", F.from_json("props", "k long").alias("s")).select("event_id", "s.*")


@query("SELECT o_orderkey, least(greatest(CAST(trunc(log10(o_totalprice)) AS INT), 0), 5) AS bucket FROM orders")
@tables
def f21_magnitude(t):
    return t.orders.select("o_orderkey", X.magnitude_bucket(F.col("o_totalprice"), 5).alias("bucket"))


@query("SELECT page_id, md5(regexp_replace(html, '(div|span)', '**\\1**', 'g')) AS digest FROM pages")
@tables
def f23_highlight(t):
    return t.pages.select("page_id", F.md5(X.highlight(F.col("html"), ["div", "span"])).alias("digest"))


@query("WITH d AS (SELECT doc_id, text, greatest(ceil(length(text) / 4), 1)::BIGINT AS s FROM documents) SELECT doc_id, " + ", ".join(f"md5(substr(text, 1 + {i} * s, s)) AS piece{i}" for i in range(4)) + " FROM d")
@tables
def f24_chunks(t):
    c = X.chunks(F.col("text"), 4)
    return t.documents.select("doc_id", *(F.md5(c[i]).alias(f"piece{i}") for i in range(4)))


@query("SELECT doc_id, md5('file ' || source || '/' || doc_id || '.py' || chr(10) || '```' || chr(10) || text || chr(10) || '```') AS digest FROM documents")
@tables
def f26_file_block(t):
    return t.documents.select("doc_id", F.md5(X.file_block(F.concat("source", F.lit("/"), "doc_id", F.lit(".py")), F.col("text"))).alias("digest"))


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE event_type END AS content FROM events")
@tables
def f28_clean_content(t):
    raw = F.when(F.col("user_id") % 5 == 0, F.lit("429: Too Many Requests ")).otherwise(F.col("event_type"))
    return t.events.select("event_id", X.clean_content(raw).alias("content"))


# samples


_SHAKEN = "h AS (SELECT * FROM (VALUES " + ", ".join(f"('Brand#{i}', '{hashlib.shake_256(f'Brand#{i}'.encode()).hexdigest(16)}')" for i in range(1, 56)) + ") v(task, h))"


@query(f"WITH {TC}, {_SHAKEN} SELECT task, n AS count FROM tc JOIN h USING (task) ORDER BY h, task LIMIT 10")
@tables
def x1_deterministic_sample(t):
    """SHAKE-256 isn't in DuckDB: its values for the brands come from hashlib."""
    return sampling.deterministic_sample(relational.value_counts(t.repos(), "tasks").where(~F.col("task").contains("/")), "task", 10)


@query(f"WITH {TC}, {_SHAKEN} SELECT task, n AS count FROM tc JOIN h USING (task) WHERE n BETWEEN (SELECT min(n) + 1 FROM tc JOIN h USING (task)) AND 10000000 ORDER BY h, task LIMIT 8")
@tables
def x2_sample_tasks(t):
    brands = t.repos().select("repo", F.filter("tasks", lambda x: ~x.contains("/")).alias("tasks"))
    least = relational.value_counts(brands, "tasks").agg(F.min("count")).first()[0]
    return sampling.sample_tasks(brands, 8, (least or 0) + 1, 10_000_000)


@query(f"WITH {TC}, big AS (SELECT repo FROM rt GROUP BY repo HAVING count(*) >= 8), top AS (SELECT task FROM tc ORDER BY n DESC, task LIMIT 15), c AS (SELECT repo, row_number() OVER (PARTITION BY task ORDER BY md5(repo::VARCHAR), repo) AS r FROM rt JOIN top USING (task) WHERE repo IN (SELECT repo FROM big)) SELECT DISTINCT repo FROM c WHERE r <= 10")
@tables
def x3_sample_repos(t):
    """The digest is a parameter; DuckDB has this one."""
    repos = t.repos()
    return sampling.sample_repos(repos, relational.top_values(repos, "tasks", 15), 10, 8, digest=lambda c: F.md5(c.cast("string"))).select("repo")


def _greedy(least: int, per: int, most: int, where: str = "TRUE") -> str:
    """The greedy sample as table expressions: own (repo, tasks) and sampled (task, repo, position). A step of the recursion takes one task, with the counts so far in a map."""
    return f"""{TC}, own AS (SELECT repo, list(task ORDER BY task) AS tasks FROM rt GROUP BY 1 HAVING {where}),
ord AS (SELECT task, row_number() OVER (ORDER BY count(*), task) AS i FROM rt WHERE repo IN (SELECT repo FROM own) GROUP BY 1 HAVING count(*) >= {least}),
g AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS task, []::BIGINT[] AS chosen, MAP {{}}::MAP(VARCHAR, BIGINT) AS given UNION ALL
SELECT i, task, chosen, map_concat(given, map_from_entries(list_transform(list_distinct(flat), lambda x: struct_pack(k := x, v := coalesce(given[x], 0) + len(list_filter(flat, lambda y: y = x))))))
FROM (SELECT c.*, coalesce((SELECT flatten(list(tasks)) FROM own WHERE list_contains(c.chosen, repo)), []) AS flat
FROM (SELECT b.i, b.task, b.given, CASE WHEN len(b.found) >= {least} THEN b.found[1:{per}] ELSE [] END AS chosen
FROM (SELECT ord.i, ord.task, g.given, coalesce((SELECT list(own.repo ORDER BY own.repo) FROM own WHERE list_contains(own.tasks, ord.task) AND len(list_filter(own.tasks, lambda x: coalesce(g.given[x], 0) > {most})) = 0), []) AS found
FROM g JOIN ord ON ord.i = g.i + 1) b) c) d),
sampled AS (SELECT task, unnest(chosen) AS repo, (generate_subscripts(chosen, 1) - 1)::INT AS position FROM g WHERE task IS NOT NULL)"""


@query(f"WITH RECURSIVE {_greedy(10, 10, 20)} SELECT task, repo, position FROM sampled")
@tables
def x4_greedy_sample(t):
    return sampling.greedy_sample(t.repos(), 10, 10, 20)


@query(f"WITH {TC}, n AS (SELECT count(DISTINCT repo) AS n FROM rt) SELECT task, count, round(p, 9) AS random_score FROM (SELECT task, tc.n AS count, CASE WHEN n.n - tc.n < 10 THEN 1.0 ELSE 1 - (SELECT exp(sum(ln((n.n - tc.n - i) / (n.n - i)))) FROM range(10) s(i)) END AS p FROM tc, n) WHERE p < 0.3")
@tables
def x7_random_score(t):
    repos = t.repos()
    n = repos.agg(F.count("*").alias("total"))
    out = sampling.without_easy_tasks(relational.value_counts(repos, "tasks").join(F.broadcast(n)), F.col("total"), 0.3)
    return out.select("task", "count", F.round("random_score", 9).alias("random_score"))


@query(f"WITH RECURSIVE {_greedy(3, 5, 100, 'count(*) <= 10')}, picked AS (SELECT * FROM own WHERE repo IN (SELECT repo FROM sampled)), ct AS (SELECT task, count(*) AS n FROM (SELECT unnest(tasks) AS task FROM picked) GROUP BY 1), valid AS (SELECT task FROM sampled UNION SELECT task FROM ct WHERE n >= 3), total AS (SELECT count(*) AS t FROM picked), kept AS (SELECT list(task) AS l FROM ct, total WHERE task IN (SELECT task FROM valid) AND CASE WHEN t - n < 10 THEN 1.0 ELSE 1 - (SELECT exp(sum(ln((t - n - i) / (t - i)))) FROM range(10) s(i)) END < 0.99) SELECT repo, array_to_string(q, ' ') AS query_tasks FROM (SELECT repo, list_filter(tasks, lambda x: list_contains(l, x)) AS q FROM picked, kept) WHERE len(q) >= 1")
@tables
def x8_sample_pipeline(t):
    repos = t.repos()
    return sampling.sample_pipeline(repos, repos.select("repo"), least_repos=3, per_task=5, most_per_task=100, most_random=0.99).select("repo", F.array_join("query_tasks", " ").alias("query_tasks"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_size % 3 ORDER BY md5(p_partkey::VARCHAR), p_partkey) <= round(count(*) OVER (PARTITION BY p_brand, p_size % 3) * 0.2) AS test FROM part")
@tables
def x9_stratified_split(t):
    return sampling.stratified_split(t.part.withColumn("b", F.col("p_size") % 3), ["p_brand", "b"], "p_partkey", 0.2).select("p_partkey", "test")


@query(f"WITH {RT} SELECT repo, NOT bool_or(task IN ('Brand#11', 'Brand#22')) AS train FROM rt GROUP BY repo")
@tables
def x10_split_by_tasks(t):
    return sampling.split_by_tasks(t.repos(), t._spark.createDataFrame([("Brand#11",), ("Brand#22",)], "task string")).select("repo", "train")


@query("SELECT p_name FROM (SELECT p_name, row_number() OVER (PARTITION BY p_brand ORDER BY substr(p_name, 2, 1) || right(p_name, 1), p_name) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM (SELECT DISTINCT p_name, p_brand FROM part)) WHERE r <= ceil(n * 0.1)")
@tables
def x11_sample_queries(t):
    return sampling.sample_queries(t.part.select("p_name", "p_brand").distinct(), "p_name", "p_brand", 0.1).select("p_name")


_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query(f"WITH {RT}, ids AS (SELECT repo, row_number() OVER (ORDER BY substr(md5(repo::VARCHAR), 1, 3), repo) - 1 AS id, count(*) OVER () AS n, {_DRAW.format("'0:' || repo")} AS s FROM (SELECT DISTINCT repo FROM rt)) SELECT a.repo, p::INT AS position, b.repo AS context FROM ids a, range(3) r(p) JOIN ids b ON b.id = (a.id + 1 + (a.s + p) % (a.n - 1)) % a.n")
@tables
def x13_few_shot_context(t):
    return sampling.few_shot_context(t.repos().select("repo"), 3)


@query(f"WITH {RT}, areas AS (SELECT DISTINCT substr(p_brand, 1, 7) AS area, p_brand || '/' || p_type AS task FROM part), num AS (SELECT *, row_number() OVER (ORDER BY area, task) - 1 AS i, count(*) OVER () AS n FROM areas), span AS (SELECT area, min(i) AS lo, count(*) AS k FROM num GROUP BY 1), d AS (SELECT repo, task, lo, k, {_DRAW.format("'0:' || repo || ':' || task")} % (n - k) AS d FROM rt JOIN num USING (task) JOIN span USING (area)) SELECT repo, d.task, num.task AS other_task FROM d JOIN num ON num.i = CASE WHEN d < lo THEN d ELSE d + k END")
@tables
def x14_task_of_another_area(t):
    areas = t.part.select(F.substring("p_brand", 1, 7).alias("area"), F.concat("p_brand", F.lit("/"), "p_type").alias("task")).distinct()
    rows = t.repos().select("repo", F.explode("tasks").alias("task")).where(F.col("task").contains("/"))
    return sampling.task_of_another_area(rows, areas)


@query(f"WITH {TC}, top AS (SELECT task FROM tc ORDER BY n DESC, task LIMIT 10), m AS (SELECT repo, task, row_number() OVER (PARTITION BY repo ORDER BY n DESC, task) AS r FROM rt JOIN tc USING (task)) SELECT repo, task AS most_common_task FROM m WHERE r = 1 AND repo IN (SELECT repo FROM rt WHERE task IN (SELECT task FROM top))")
@tables
def x17_biggest_tasks(t):
    return sampling.biggest_tasks(t.repos().withColumnRenamed("repo", "paper"), 10).select(F.col("paper").alias("repo"), "most_common_task")


@query(f"WITH {TC} SELECT repo, task AS least_common_task FROM (SELECT DISTINCT repo FROM rt) LEFT JOIN (SELECT repo, min(task) AS task FROM rt JOIN tc USING (task) WHERE n > 50 GROUP BY 1) USING (repo)")
@tables
def x19_least_common_task(t):
    return sampling.least_common_task(t.repos().withColumnRenamed("repo", "paper"), 50).select(F.col("paper").alias("repo"), "least_common_task")


@query(f"WITH {RT}, cl AS (SELECT repo AS title, trim(lower(replace(regexp_replace(task, '[0-9]+d', '', 'g'), '-', ' '))) AS task, row_number() OVER (PARTITION BY repo ORDER BY task) AS pos FROM rt), vc AS (SELECT task FROM cl GROUP BY 1 HAVING count(*) >= 10), valid AS (SELECT title, task, pos, count(*) OVER (PARTITION BY title) AS k FROM cl WHERE task IN (SELECT task FROM vc)), best AS (SELECT DISTINCT ON (repo) o_custkey AS repo, title FROM valid JOIN orders ON o_orderkey = title ORDER BY repo, k DESC, 't' || title), rows AS (SELECT repo, task, pos FROM best JOIN valid USING (title)), n AS (SELECT task FROM rows GROUP BY 1 HAVING count(*) > 10), least AS (SELECT DISTINCT ON (repo) repo, task AS least_common_task FROM rows WHERE task IN (SELECT task FROM n) ORDER BY repo, pos) SELECT repo, least_common_task, string_agg(task, ';' ORDER BY pos) AS tasks FROM rows JOIN least USING (repo) WHERE task IN (SELECT least_common_task FROM least) GROUP BY 1, 2")
@tables
def x20_task_table(t):
    papers = t.repos().select(F.concat(F.lit("t"), "repo").alias("title"), "tasks")
    links = t.orders.select(F.concat(F.lit("t"), "o_orderkey").alias("paper_title"), F.col("o_custkey").alias("repo"))
    return sampling.task_table(papers, links, 10).select("repo", F.array_join("tasks", ";").alias("tasks"), "least_common_task")


@query("SELECT area, task FROM (SELECT p_brand AS area, trim(lower(replace(regexp_replace(p_name, '[0-9]+d', '', 'g'), '-', ' '))) AS task, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE n > 1")
@tables
def x21_area_tasks(t):
    return sampling.area_tasks(t.part.select(F.col("p_brand").alias("area"), F.col("p_name").alias("task")))


@query(f"WITH {RT} SELECT task, count(DISTINCT 't' || repo) AS titles FROM rt GROUP BY task")
@tables
def x24_titles_by_task(t):
    return sampling.titles_by_task(t.repos().select(F.concat(F.lit("t"), "repo").alias("title"), "tasks")).select("task", F.size("titles").cast("long").alias("titles"))


# code

_S = "s AS (SELECT 'r' || s_nationkey AS r, 'src/s' || s_suppkey || '.py' AS p, 's' || s_suppkey AS base, s_suppkey AS k, s_nationkey AS n, s_suppkey % 3 AS v FROM supplier), a AS (SELECT * FROM s WHERE v = 0), b AS (SELECT * FROM s WHERE v = 1), c AS (SELECT * FROM s WHERE v = 2)"


@query(f"WITH {_S} SELECT r AS repo_name, target, source, edge_type, (row_number() OVER (PARTITION BY p ORDER BY kind, i) - 1)::INT AS ordinal FROM (SELECT r, p, 0 AS kind, 0 AS i, p AS target, r AS source, 'repo-file' AS edge_type FROM s WHERE v < 2 UNION ALL SELECT r, p, 1, 0, 'C' || k, p, 'file-class' FROM a UNION ALL SELECT r, p, 2, 0, 'f' || n, p, 'file-function' FROM a UNION ALL SELECT r, p, 2, 0, 'g' || k, p, 'file-function' FROM b UNION ALL SELECT r, p, 3, unnest([0, 1, 2]), unnest(['lib' || n || '.helper', 'numpy', 'os']), p, 'file-import' FROM a UNION ALL SELECT r, p, 3, unnest([0, 1, 2]), unnest(['json', 'pkg' || n || '.mod.other', 'pkg' || n || '.mod.tool']), p, 'file-import' FROM b UNION ALL SELECT r, p, 4, 0, 'Base', 'C' || k, 'inheritance' FROM a UNION ALL SELECT r, p, 5, 0, 'run', 'C' || k, 'class-method' FROM a UNION ALL SELECT r, p, 6, unnest([0, 1, 2, 3]), unnest(['os.getcwd', 'step', 'helper', 'numpy.load']), unnest(['C' || k || '.run', 'C' || k || '.run', 'f' || n, 'f' || n]), 'function-function' FROM a UNION ALL SELECT r, p, 6, unnest([0, 1, 2]), unnest(['json.dumps', 'other', 'tool']), 'g' || k, 'function-function' FROM b UNION ALL SELECT r, p, 7, unnest([0, 1]), unnest(['helper', 'os.getcwd']), unnest(['lib' || n || '.helper', 'os']), 'import-import' FROM a UNION ALL SELECT r, p, 7, unnest([0, 1]), unnest(['json.dumps', 'other']), unnest(['json', 'pkg' || n || '.mod.other']), 'import-import' FROM b)")
@tables
def t2_extract_edges(t):
    return code.extract_edges(t.sources())


@query(f"WITH {_S} SELECT r AS repo, string_agg(DISTINCT m, ' ' ORDER BY m) AS imports FROM (SELECT r, unnest(['os', 'numpy', 'lib' || n]) AS m FROM a UNION ALL SELECT r, unnest(['json', 'pkg' || n]) FROM b) GROUP BY 1")
@tables
def t5_module_corpus(t):
    return code.module_corpus(t.sources()).select("repo", F.array_join("imports", " ").alias("imports"))


@query(f"WITH {_S} SELECT p AS path, CASE v WHEN 0 THEN '# supplier ' || k || chr(10) || '...' || chr(10) || 'class C' || k || '(Base):' WHEN 1 THEN '' END AS selected_code FROM s")
@tables
def t8_selected_code(t):
    return t.sources().select("path", code.selected_code(F.col("content")).alias("selected_code"))


@query(f"WITH {_S} SELECT p AS path, text, line_start::INT AS line_start, line_end::INT AS line_end, match_type FROM (SELECT p, unnest(['# supplier ' || k, 'class C' || k || '(Base):', chr(10) || '    def run(self):']) AS text, unnest([4, 4, 4]) AS line_start, unnest([4, 5, 6]) AS line_end, unnest(['comment', 'signature', 'signature']) AS match_type FROM a UNION ALL SELECT p, '# step', 7, 7, 'comment' FROM b)")
@tables
def t7_matches(t):
    return t.sources().select("path", F.inline(code.match_spans(F.col("content"))))


@query(f"WITH {_S} SELECT r AS repo_name, p AS path, unnest(['run', 'f' || n]) AS function_name, unnest(['    def run(self):', 'def f' || n || '(a):']) AS function_signature FROM a UNION ALL SELECT r, p, 'g' || k || '(x, y=json.dumps', '@other' || chr(10) || 'def g' || k || '(x, y=json.dumps({{}})):' FROM b UNION ALL SELECT r, p, 'broken', 'def broken(:' FROM c")
@tables
def t11_signature_table(t):
    return code.signature_table(t.sources())


@query(f"WITH {_S} SELECT r AS repo_name, p AS path, unnest(['C' || k, 'f' || n]) AS function_name, unnest(['class C' || k || '(Base):' || chr(10) || chr(10) || '    def run(self):' || chr(10) || '        self.step()' || chr(10) || '        os.getcwd()', 'def f' || n || '(a):' || chr(10) || '    return helper(np.load(a))']) AS function_code FROM a UNION ALL SELECT r, p, 'g' || k, '@other' || chr(10) || 'def g' || k || '(x, y=json.dumps({{}})):' || chr(10) || '    z = t(x) + other(y)' || chr(10) || '    return z' FROM b")
@tables
def t13_function_table(t):
    return code.function_table(t.sources())


@query(f"WITH {_S} SELECT p AS path, CASE v WHEN 0 THEN 'C' || k ELSE '' END AS classes, CASE v WHEN 0 THEN 'run f' || n WHEN 1 THEN 'g' || k ELSE 'broken' END AS functions FROM s")
@tables
def t14_names(t):
    return t.sources().select("path", F.array_join(code.names_by_prefix(F.col("content"), "class"), " ").alias("classes"), F.array_join(code.names_by_prefix(F.col("content"), "def"), " ").alias("functions"))


@query(f"WITH {_S} SELECT p AS path, array_to_string(list_sort(list_filter(CASE v WHEN 0 THEN ['base', 'c' || k, 'f' || n, 'getcwd', 'helper', 'lib' || n, 'load', 'numpy', 'run', 'self', 'step'] WHEN 1 THEN ['dumps', 'g' || k, 'json', 'loads', 'mod', 'other', 'pkg' || n, 'tool'] END, lambda x: length(x) > 2)), ' ') AS tokens FROM s")
@tables
def t15_name_tokens(t):
    return t.sources().select("path", F.array_join(code.name_tokens(F.col("content")), " ").alias("tokens"))


@query(f"WITH {_S} SELECT p AS path, 'g' || k AS source, unnest(['other', 't']) AS target FROM b")
@tables
def t16_legacy_calls(t):
    return t.sources().select("path", F.inline(code.legacy_calls(F.col("content"))))


_LEGACY = _S + ", le AS (SELECT source, destination, edge_type, min(r) AS repo FROM (SELECT '<ROOT>' AS source, r AS destination, 'root-repo' AS edge_type, r FROM s UNION ALL SELECT r, base, 'repo-file', r FROM s UNION ALL SELECT base, 'g' || k, 'file-function', r FROM b UNION ALL SELECT 'g' || k, unnest(['other', 't']), 'function-function', r FROM b) GROUP BY 1, 2, 3)"


@query(f"WITH {_LEGACY} SELECT * FROM le")
@tables
def t17_legacy_edges(t):
    return code.legacy_edges(t.sources())


@query(f"WITH {_S}, few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY p) AS i FROM s WHERE NOT starts_with(p, 'src/s1')) WHERE i <= 2) SELECT source, destination, edge_type, min(r) AS repo FROM (SELECT '<ROOT>' AS source, r AS destination, 'root-repo' AS edge_type, r FROM few UNION ALL SELECT r, r || ':' || base, 'repo-file', r FROM few UNION ALL SELECT r || ':' || base, 'g' || k, 'file-function', r FROM few WHERE v = 1 UNION ALL SELECT 'g' || k, unnest(['other', 't']), 'function-function', r FROM few WHERE v = 1) GROUP BY 1, 2, 3")
@tables
def t18_labelled_sample_of_edges(t):
    return code.legacy_edges(t.sources(), labelled=True, per_repo=2, without="src/s1")


@query(f"WITH {_LEGACY}, {RT}, pairs AS (SELECT DISTINCT 'n' || x.k AS source, 'n' || y.k AS destination FROM (SELECT DISTINCT s_nationkey AS k, s_suppkey % 40 AS t FROM supplier) x JOIN (SELECT DISTINCT s_nationkey AS k, s_suppkey % 40 AS t FROM supplier) y ON x.t = y.t AND 'n' || x.k < 'n' || y.k) SELECT source, destination, edge_type, repo FROM le WHERE source <> '<ROOT>' UNION ALL SELECT source, destination, 'repo-repo', NULL FROM pairs")
@tables
def t19_postprocessed_edges(t):
    papers = t.supplier.groupBy(F.concat(F.lit("n"), "s_nationkey").alias("repo")).agg(F.collect_set(F.col("s_suppkey") % 40).alias("tasks"))
    return code.postprocess_edges(code.legacy_edges(t.sources()), papers=papers)


@query(f"WITH {_LEGACY} SELECT source, string_agg(DISTINCT destination, ' ' ORDER BY destination) AS description FROM le WHERE source <> '<ROOT>' GROUP BY 1")
@tables
def t19_described_edges(t):
    return code.postprocess_edges(code.legacy_edges(t.sources()), described=True)


@query(f"WITH {_S}, f AS (SELECT r AS repo, string_agg(DISTINCT m, ' ' ORDER BY m) AS imports FROM (SELECT r, unnest(['os', 'numpy', 'lib' || n]) AS m FROM a UNION ALL SELECT r, unnest(['json', 'pkg' || n]) FROM b) GROUP BY 1) SELECT repo, title, imports FROM (SELECT 'r' || n_nationkey AS repo, n_name AS title FROM nation) JOIN f USING (repo)")
@tables
def t6_papers_with_imports(t):
    return code.papers_with_imports(t.nation.select(F.concat(F.lit("r"), "n_nationkey").alias("repo"), F.col("n_name").alias("title")), t.sources())


@query(f"WITH {EDGES}, d AS (SELECT node, count(*) AS n FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY 1) SELECT * FROM e WHERE source IN (SELECT node FROM d WHERE n >= 4) AND target IN (SELECT node FROM d WHERE n >= 4)")
@tables
def t21_prune(t):
    return graph.prune(t.edges(), 4)


# graphs


@query(f"WITH {EDGES} SELECT DISTINCT repo_name, source, target FROM e")
@tables
def g1_collapse(t):
    return graph.collapse(t.edges())


@query(f"WITH RECURSIVE {EDGES}, g AS (SELECT DISTINCT repo_name, source, target FROM e), o AS (SELECT repo_name, source AS node, count(*) AS out FROM g GROUP BY 1, 2), nodes AS (SELECT repo_name, node FROM (SELECT repo_name, source AS node FROM g UNION SELECT repo_name, target FROM g)), n AS (SELECT nodes.*, out, count(*) OVER (PARTITION BY repo_name) AS n FROM nodes LEFT JOIN o USING (repo_name, node)), r AS (SELECT 0 AS i, repo_name, node, 1.0::DOUBLE / n AS x FROM n UNION ALL SELECT i + 1, repo_name, node, 0.85 * (coalesce(s, 0) + coalesce(loose, 0) / n) + 0.15 / n FROM (SELECT r.i, n.repo_name, n.node, n.n, sum(CASE WHEN n.out IS NULL THEN r.x END) OVER (PARTITION BY n.repo_name) AS loose, (SELECT 0) AS z, h.s FROM r JOIN n USING (repo_name, node) LEFT JOIN (SELECT g.repo_name, g.target AS node, sum(r.x / o.out) AS s FROM r JOIN g ON g.repo_name = r.repo_name AND g.source = r.node JOIN o ON o.repo_name = r.repo_name AND o.node = r.node GROUP BY 1, 2) h ON h.repo_name = n.repo_name AND h.node = n.node) WHERE i < 60) SELECT repo_name, node, round(x, 8) AS centrality_score FROM r WHERE i = 60")
@tables
def g2_pagerank(t):
    return graph.pagerank(t.edges(), tolerance=1e-12).withColumn("centrality_score", F.round("centrality_score", 8))


_DEG = EDGES + ", g AS (SELECT DISTINCT repo_name, source, target FROM e), deg AS (SELECT repo_name, node, count(*)::DOUBLE AS centrality_score FROM (SELECT repo_name, source AS node FROM g UNION ALL SELECT repo_name, target FROM g) GROUP BY 1, 2), ends AS (SELECT repo_name, source AS node, edge_type, 'source' AS role, 2 * ordinal AS place FROM e UNION ALL SELECT repo_name, target, edge_type, 'target', 2 * ordinal + 1 FROM e), meta AS (SELECT repo_name, node, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS node_edge_type, string_agg(DISTINCT role, ',' ORDER BY role) AS node_role FROM ends GROUP BY 1, 2)"


@query(f"WITH {_DEG} SELECT * FROM deg")
@tables
def g3_degree(t):
    return graph.degree(t.edges())


@query(f"WITH {_DEG} SELECT * FROM meta")
@tables
def g4_node_metadata(t):
    return graph.node_metadata(t.edges())


_CEN = _DEG + ", cand AS (SELECT repo_name, edge_type, node, min(place) AS place FROM ends GROUP BY 1, 2, 3), cen AS (SELECT repo_name, node, centrality_score, edge_type, node_edge_type, node_role FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, edge_type ORDER BY centrality_score DESC, place, node) AS r FROM cand JOIN deg USING (repo_name, node) JOIN meta USING (repo_name, node)) WHERE r <= CASE edge_type WHEN 'R' THEN 10 ELSE 5 END AND edge_type IN ('A', 'R'))"


@query(f"WITH {_CEN} SELECT * FROM cen")
@tables
def g5_centralities(t):
    return graph.centralities(t.edges(), {"A": 5, "R": 10}, method="degree")


@query(f"WITH {_CEN}, x AS (SELECT repo_name, node, centrality_score, unnest(string_split(node_edge_type, ',')) AS section FROM cen), k AS (SELECT *, row_number() OVER (PARTITION BY repo_name, section ORDER BY centrality_score DESC, node) AS r FROM x), b AS (SELECT repo_name, section, string_agg(node, ', ' ORDER BY r) AS nodes FROM k WHERE r <= 10 GROUP BY 1, 2) SELECT repo_name AS repo, md5('repo: ' || repo_name || string_agg(chr(10) || chr(10) || section || ':' || chr(10) || nodes, '' ORDER BY section)) AS digest FROM b WHERE section IN ('A', 'N', 'R') GROUP BY 1")
@tables
def g6_dependency_signatures(t):
    s = graph.dependency_signatures(graph.centralities(t.edges(), {"A": 5, "R": 10}, method="degree"), ("A", "N", "R"))
    return s.select("repo", F.md5("dependency_signature").alias("digest"))


def _global_rank(article: bool) -> str:
    extra = "(SELECT count(*) FROM g) / (SELECT count(*) FROM nodes)::DOUBLE" if article else "0"
    loose = "0" if article else "coalesce(sum(CASE WHEN n.out IS NULL THEN r.x END) OVER (), 0)"
    return f"WITH RECURSIVE {EDGES}, g AS (SELECT DISTINCT source, target FROM e), o AS (SELECT source AS node, count(*) AS out FROM g GROUP BY 1), nodes AS (SELECT source AS node FROM g UNION SELECT target FROM g), n AS (SELECT node, out, count(*) OVER () AS n FROM nodes LEFT JOIN o USING (node)), r AS (SELECT 0 AS i, node, 1.0::DOUBLE / n AS x FROM n UNION ALL SELECT i + 1, node, 0.85 * (coalesce(s, 0) + loose / n) + 0.15 / n FROM (SELECT r.i, n.node, n.n, {loose} AS loose, h.s FROM r JOIN n USING (node) LEFT JOIN (SELECT g.target AS node, sum(r.x / (o.out + {extra})) AS s FROM r JOIN g ON g.source = r.node JOIN o ON o.node = r.node GROUP BY 1) h ON h.node = n.node) WHERE i < 10) SELECT node, round(x, 9) AS rank FROM r WHERE i = 10"


@query(_global_rank(False))
@tables
def g10_pagerank_global(t):
    return graph.pagerank_global(t.edges(), steps=10, tolerance=0).withColumn("rank", F.round("rank", 9))


@query(_global_rank(True))
@tables
def g10_article_rank(t):
    return graph.pagerank_global(t.edges(), steps=10, tolerance=0, article=True).withColumn("rank", F.round("rank", 9))


@query(f"WITH {EDGES} SELECT source AS node, md5(string_agg(DISTINCT target, ' ' ORDER BY target)) AS digest FROM e GROUP BY 1")
@tables
def g12_out_neighbours(t):
    e = t.edges()
    return graph.out_neighbours(e, e.select(F.col("source").alias("node"))).select("node", F.md5(F.array_join("neighbours", " ")).alias("digest"))


@query(f"WITH {EDGES} SELECT edge_type, count(*) AS count FROM e GROUP BY 1")
@tables
def g17_typed_histogram(t):
    return graph.typed_histogram(t.edges())


@query(f"WITH {RT} SELECT task, count(*) AS n, md5(string_agg(repo::VARCHAR, ' ' ORDER BY repo)) AS repos FROM rt GROUP BY 1")
@tables
def t22_repo_task_edges(t):
    return graph.repo_task_edges(t.repos()).select("task", F.size("repos").cast("long").alias("n"), F.md5(F.array_join(F.col("repos").cast("array<string>"), " ")).alias("repos"))


@query()
@tables
def flow_signatures(t):
    return flows.signatures_of_files(t.sources())


# retrieval

_TERMS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query("WITH q AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest(" + _TERMS.format("text") + ") AS term FROM benchmark) GROUP BY 1, 2), b AS (SELECT doc_id, " + _TERMS.format("text") + " AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM b), tf AS (SELECT doc_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM b) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), r AS (SELECT query_id, doc_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY 1, 2) SELECT query_id, doc_id, round(score, 6) AS score FROM r")
@tables
def r1_bm25(t):
    qs = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.bm25(t.documents.select("doc_id", "text"), qs).withColumn("score", F.round("score", 6))


_VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings), u AS (SELECT vec_id, label, list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) AS d FROM v)"


@query(f"WITH {_VEC} SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_dot_product(a.d, b.d) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.d, b.d) DESC, b.vec_id) AS r FROM u a, u b WHERE a.vec_id % 50 = 0) WHERE r <= 10")
@tables
def r2_dense(t):
    d = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    q = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense(d, q, 10).withColumn("score", F.round("score", 6))


_HYBRID = RES + ", turns AS (SELECT query_id, doc_id, score / sum(score) OVER (PARTITION BY query_id) AS score, 2 * row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS turn, count(*) OVER (PARTITION BY query_id) AS n FROM res UNION ALL SELECT query_id, doc_id, s / sum(s) OVER (PARTITION BY query_id), 2 * row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id DESC) + 1, count(*) OVER (PARTITION BY query_id) FROM (SELECT query_id, doc_id, round(1e7 / score, 6) AS s FROM res)), firsts AS (SELECT query_id, doc_id, min(turn) AS turn FROM turns GROUP BY 1, 2), fresh AS (SELECT query_id, turn // 2 AS pass, count(*) AS k FROM firsts GROUP BY 1, 2), passes AS (SELECT query_id, p AS pass, coalesce((SELECT sum(k) FROM fresh f WHERE f.query_id = q.query_id AND f.pass < p), 0) AS before, n FROM (SELECT query_id, max(n) AS n FROM turns GROUP BY 1) q, range(1, n + 1) r(p)), used AS (SELECT t.* FROM turns t JOIN passes p ON p.query_id = t.query_id AND p.pass = t.turn // 2 WHERE p.before < p.n)"


@query(f"WITH {_HYBRID} SELECT query_id, doc_id, round(max_by(score, turn), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY min(turn))::INT AS position FROM used GROUP BY 1, 2")
@tables
def r4_hybrid(t):
    """Alternate popping; tests hold it against a loop too."""
    return retrieval.hybrid(t.results(), t.results().withColumn("score", F.round(1e7 / F.col("score"), 6))).withColumn("score", F.round("score", 9))


_TFIDF = "w AS (SELECT source AS grp, doc_id, term, count(*) AS tf FROM (SELECT source, doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS term FROM documents) GROUP BY 1, 2, 3), df AS (SELECT grp, term, count(*) AS df FROM w GROUP BY 1, 2), n AS (SELECT source AS grp, count(*) AS n FROM documents GROUP BY 1), x AS (SELECT w.grp, doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM w JOIN df USING (grp, term) JOIN n ON n.grp = w.grp), norm AS (SELECT grp, doc_id, sqrt(sum(x * x)) AS norm FROM x GROUP BY 1, 2)"


@query(f"WITH {_TFIDF}, s AS (SELECT q.grp, q.doc_id AS query_id, d.doc_id, sum(q.x * d.x) AS s FROM x q JOIN x d ON q.grp = d.grp AND q.term = d.term WHERE q.doc_id % 50 = 0 GROUP BY 1, 2, 3) SELECT s.grp, query_id, s.doc_id, round(s / (a.norm * b.norm), 6) AS score FROM s JOIN norm a ON a.grp = s.grp AND a.doc_id = query_id JOIN norm b ON b.grp = s.grp AND b.doc_id = s.doc_id")
@tables
def r7_tfidf(t):
    d = t.documents.select(F.col("source").alias("grp"), "doc_id", "text")
    q = d.where("doc_id % 50 = 0").select("grp", F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.tfidf_cosine(d, q).withColumn("score", F.round("score", 6))


@query("WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings), e AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(d) AS x, generate_subscripts(d, 1) AS pos FROM v) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY pos) AS m FROM e GROUP BY 1), s AS (SELECT label, vec_id, list_dot_product(d, m) / (sqrt(list_dot_product(d, d)) * sqrt(list_dot_product(m, m))) AS score FROM v JOIN c USING (label)) SELECT label, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5")
@tables
def r8_nearest_to_mean(t):
    return retrieval.nearest_to_mean(t.embeddings, "label", "vec_id", 5).withColumn("score", F.round("score", 6))


# corpus and measures


@query(f"WITH {TC} SELECT (row_number() OVER (ORDER BY n DESC, task) - 1)::VARCHAR AS query_id, task AS query FROM tc WHERE n >= 10")
@tables
def c1_queries(t):
    return metrics.queries(t.repos(), 10, "tasks")


@query(f"WITH {TC}, q AS (SELECT (row_number() OVER (ORDER BY n DESC, task) - 1)::VARCHAR AS query_id, task FROM tc WHERE n >= 10) SELECT query_id, repo AS doc_id, 1::INT AS rel FROM rt JOIN q USING (task)")
@tables
def c2_judgements(t):
    repos = t.repos()
    return metrics.judgements(repos, metrics.queries(repos, 10, "tasks"))


@query("SELECT corpus, s_suppkey AS doc_id, s_suppkey AS title, text FROM (SELECT s_suppkey, unnest(['name', 'all']) AS corpus, unnest([s_name, s_name || chr(10) || s_nationkey]) AS text FROM supplier)")
@tables
def c3_corpora(t):
    return metrics.corpora(t.supplier.withColumnRenamed("s_suppkey", "repo"), {"name": ["s_name"], "all": ["s_name", "s_nationkey"]})


@query(f"WITH {RANKED} SELECT round((1 + count(*) FILTER (WHERE hit AND r <= 10)) / (SELECT count(DISTINCT query_id) FROM rel), 5) AS \"Hits@10\" FROM rk")
@tables
def m1_hits(t):
    return metrics.hits_at_k(t.results(), t.qrels(), 10)


@query(f"WITH {RANKED} SELECT query_id, " + ", ".join(f"(count(*) FILTER (WHERE hit AND r <= {k}))::DOUBLE AS \"Hits@{k}\", (count(*) FILTER (WHERE hit AND r <= {k}) > 0)::INT::DOUBLE AS \"Accuracy@{k}\", count(*) FILTER (WHERE hit AND r <= {k}) / {k} AS \"Precision@{k}\"" for k in metrics.KS) + " FROM rk GROUP BY 1")
@tables
def m2_per_query(t):
    return metrics.per_query(t.results(), t.qrels())


@query(f"WITH {RANKED}, n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1), h AS (SELECT *, sum(hit::INT) OVER (PARTITION BY query_id ORDER BY r) AS so_far FROM rk WHERE r <= 10), a AS (SELECT query_id, sum(hit::INT) AS hits, sum(CASE WHEN hit THEN so_far / r ELSE 0 END) AS ap, sum(CASE WHEN hit THEN 1 / log2(r + 1) ELSE 0 END) AS dcg, min(r) FILTER (WHERE hit) AS first, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM rel)) AS holes FROM h GROUP BY 1) SELECT query_id, round(coalesce(hits, 0) / n, 6) AS recall, round(coalesce(hits, 0) / least(n, 10), 6) AS r_cap, round(coalesce(hits, 0) / 10, 6) AS precision, round(coalesce(ap, 0) / n, 6) AS map, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 2)) FROM range(least(n, 10)) s(i)), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(holes, 0) / 10, 6) AS hole FROM n LEFT JOIN a USING (query_id)")
@tables
def m4_standard(t):
    got = metrics.standard(t.results(), t.qrels(), 10)
    return got.select("query_id", *(F.round(c, 6).alias(c) for c in got.columns[1:]))


@query("SELECT corpus, retriever, round(avg(value), 6) AS value FROM (SELECT user_id, user_id % 3 AS corpus, event_type AS retriever, avg(value) AS value FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2")
@tables
def m6_two_level_means(t):
    rows = t.events.withColumnRenamed("event_type", "retriever").withColumn("corpus", F.col("user_id") % 3)
    first = metrics.mean_by(rows, ["user_id", "corpus", "retriever"], ["value"])
    return metrics.mean_by(first, ["corpus", "retriever"], ["value"]).withColumn("value", F.round("value", 6))


@query("WITH p AS (SELECT p_partkey, " + _TERMS.format("p_name || ' ' || p_type") + " AS a, " + _TERMS.format("p_type || ' ' || p_brand") + " AS b FROM part), x AS (SELECT p_partkey, w, count(*) AS n FROM (SELECT p_partkey, unnest(a) AS w FROM p) GROUP BY 1, 2), y AS (SELECT p_partkey, w, count(*) AS n FROM (SELECT p_partkey, unnest(b) AS w FROM p) GROUP BY 1, 2), m AS (SELECT p_partkey, sum(least(x.n, y.n)) AS m FROM x JOIN y USING (p_partkey, w) GROUP BY 1) SELECT p_partkey, round(2 * coalesce(m, 0) / (len(a) + len(b)), 6) AS rouge1, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM p LEFT JOIN m USING (p_partkey)")
@tables
def m7_rouge1(t):
    df = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("reference"), F.concat_ws(" ", "p_type", "p_brand").alias("generated"))
    out = metrics.rouge_n(df, "p_partkey", "reference", "generated", 1, "rouge1")
    return out.select("p_partkey", F.round("rouge1", 6).alias("rouge1"), F.round(metrics.jaccard(retrieval.terms(F.col("reference")), retrieval.terms(F.col("generated"))), 6).alias("jaccard"))


@query()
@tables
def m8_generation_metrics(t):
    df = t.part.select(F.col("p_partkey").alias("repo"), F.concat_ws(" ", "p_name", "p_type").alias("reference"), F.concat_ws(" ", "p_type", "p_brand").alias("generated"))
    return metrics.generation_metrics(df)


@query(f"WITH {RT} SELECT task, round(avg(o_totalprice), 4) AS o_totalprice FROM rt JOIN orders ON o_orderkey = repo GROUP BY 1")
@tables
def m9_per_task(t):
    rows = t.repos().join(t.orders.select(F.col("o_orderkey").alias("repo"), "o_totalprice"), "repo").select("tasks", "o_totalprice")
    return metrics.per_task(rows).withColumn("o_totalprice", F.round("o_totalprice", 4))


# statistics


def _tail(z: str) -> str:
    """P(Z > z) in SQL, by the series of the error function; beyond 5 it is 0 or 1 to six digits."""
    x = f"(({z}) / sqrt(2))"
    series = f"2 / sqrt(pi()) * list_sum(list_transform(range(90), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow({x}, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))"
    return f"CASE WHEN ({z}) > 5 THEN 0 WHEN ({z}) < -5 THEN 1 ELSE (1 - {series}) / 2 END"


@query("WITH m AS (SELECT user_id, round(avg(value), 3) AS a, count(*) AS b FROM events GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS y FROM m) SELECT round(corr(x, y), 9) AS rho, count(*) AS n FROM r")
@tables
def z1_spearman(t):
    return stats.spearman(_per_user(t), "a", "b").withColumn("rho", F.round("rho", 9))


def _per_user(t) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.round(F.avg("value"), 3).alias("a"), F.count("*").alias("b"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 9) AS r FROM lineitem GROUP BY 1")
@tables
def z2_pearson(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 9).alias("r"))


@query("WITH m AS (SELECT user_id, round(avg(value), 3) AS a, count(*) AS b FROM events GROUP BY 1), p AS (SELECT sign(x.a - y.a) * sign(x.b - y.b) AS s, (x.a = y.a)::INT AS ta, (x.b = y.b)::INT AS tb FROM m x JOIN m y ON x.user_id < y.user_id) SELECT round(sum(s) / sqrt((count(*) - sum(ta)) * (count(*) - sum(tb))), 9) AS tau, (SELECT count(*) FROM m) AS n FROM p")
@tables
def z3_kendall(t):
    return stats.kendall(_per_user(t), "a", "b").withColumn("tau", F.round("tau", 9))


@query("WITH x AS (SELECT l_returnflag = 'A' AS f, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r, count(*) OVER (PARTITION BY l_quantity)::DOUBLE AS k FROM lineitem WHERE l_returnflag IN ('A', 'R')), a AS (SELECT count(*) FILTER (WHERE f) AS n1, count(*) FILTER (WHERE NOT f) AS n2, sum(r) FILTER (WHERE f) AS r, sum(k * k - 1) AS t FROM x), b AS (SELECT n1, n2, r - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 2.0 AS m, sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - t / ((n1 + n2) * (n1 + n2 - 1.0)))) AS d FROM a) SELECT n1, n2, u, round((u - m) / d, 6) AS z, round(least(1.0, 2 * (" + _tail("(abs(u - m) - 0.5) / d") + ")), 6) AS p, round(" + _tail("-(u - m + 0.5) / d") + ", 6) AS p_less FROM b")
@tables
def z4_mann_whitney(t):
    return stats.mann_whitney(t.lineitem, "l_quantity", "l_returnflag", "A", "R").select("n1", "n2", "u", *(F.round(c, 6).alias(c) for c in ("z", "p", "p_less")))


@query("WITH d AS (SELECT o_orderkey, sum(l_quantity) FILTER (WHERE l_linenumber = 1) - sum(l_quantity) FILTER (WHERE l_linenumber = 2) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY abs(d))::DOUBLE AS k FROM d WHERE d <> 0), a AS (SELECT count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, sum(k * k - 1) AS t FROM r), b AS (SELECT n, w, (w - n * (n + 1) / 4.0) / sqrt((n * (n + 1.0) * (2 * n + 1) - t / 2.0) / 24) AS z FROM a) SELECT n, w, round(z, 6) AS z, round(least(1.0, 2 * (" + _tail("-z") + ")), 6) AS p FROM b")
@tables
def z5_wilcoxon(t):
    q = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_linenumber") == 1, F.col("l_quantity"))).alias("x"), F.sum(F.when(F.col("l_linenumber") == 2, F.col("l_quantity"))).alias("y"))
    return stats.wilcoxon(q, "x", "y").select("n", "w", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query("WITH a AS (SELECT l_quantity AS v, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1), d AS (SELECT max(abs(x - y)) AS d, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2 FROM (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS x, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS y, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM a)) SELECT round(d, 9) AS d, n1, n2, round(least(1.0, greatest(0.0, (SELECT sum(2 * pow(-1, k - 1) * exp(-2.0 * k * k * d * d * n1 * n2 / (n1 + n2))) FROM range(1, 101) r(k)))), 6) AS p FROM d")
@tables
def z6_kolmogorov_smirnov(t):
    return stats.kolmogorov_smirnov(t.lineitem, "l_quantity", "l_returnflag", "A", "R").select(F.round("d", 9).alias("d"), "n1", "n2", F.round("p", 6).alias("p"))


@query("SELECT event_type, round(avg(value) FILTER (WHERE user_id % 2 = 0) - avg(value) FILTER (WHERE user_id % 2 = 1), 6) AS difference, true AS p_is_a_share FROM events GROUP BY 1")
@tables
def z7_permutation_test(t):
    """The observed difference, and whether p is one of the values that 200 rounds can give; tests hold p against plain shufflings."""
    e = t.events.withColumn("g", F.col("user_id") % 2)
    got = stats.permutation_test(e, "value", "g", 0, 1, ["event_type"], rounds=200)
    hits = F.col("p") * 201
    return got.select("event_type", F.round("difference", 6).alias("difference"), ((hits >= 0.999) & (hits <= 201.001) & (F.abs(hits - F.round(hits)) < 1e-6)).alias("p_is_a_share"))


@query("WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(o) AS r FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS c FROM c GROUP BY 1), n AS (SELECT sum(o) AS n FROM c) SELECT round(sum((coalesce(o, 0) - r * c / n) * (coalesce(o, 0) - r * c / n) / (r * c / n)), 6) AS chi2, (count(DISTINCT r.a) - 1) * (count(DISTINCT k.b) - 1) AS dof FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c ON c.a = r.a AND c.b = k.b")
@tables
def z8_chi_square(t):
    return stats.chi_square(t.lineitem.select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")), "a", "b").withColumn("chi2", F.round("chi2", 6))


@query("WITH m AS (SELECT avg(value) AS m FROM events) SELECT round(avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5), 6) AS skew FROM events, m")
@tables
def z9_skewness(t):
    return t.events.agg(F.round(F.skewness("value"), 6).alias("skew"))


@query("SELECT event_type, 100.0 * (count(*) FILTER (WHERE value < 50) + count(*) FILTER (WHERE value <= 50)) / (2 * count(value)) AS percentile FROM events GROUP BY 1")
@tables
def z10_percentile_of(t):
    return t.events.groupBy("event_type").agg(stats.percentile_of(t.events, "value", F.lit(50)).alias("percentile"))


@query("SELECT i / 20 AS q, round(v[i + 1], 6) AS value FROM (SELECT quantile_cont(value, [" + ", ".join(str(i / 20) for i in range(21)) + "]) AS v FROM events), range(21) s(i)")
@tables
def z11_quantile_grid(t):
    return stats.quantile_grid(t.events, "value", 20).select("q", F.round("value", 6).alias("value"))


@query("SELECT o_orderpriority, round(m, 4) AS o_totalprice_marked, round(a, 4) AS o_totalprice_all, round(m - a, 4) AS o_totalprice_diff, round(100 * (m - a) / a, 6) AS o_totalprice_percent FROM (SELECT o_orderpriority, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS m, avg(o_totalprice) AS a FROM orders GROUP BY 1)")
@tables
def z13_group_differences(t):
    d = stats.group_differences(t.orders, ["o_orderpriority"], F.col("o_orderstatus") == "F", ["o_totalprice"])
    return d.select("o_orderpriority", *(F.round(f"o_totalprice_{c}", 6 if c == "percent" else 4).alias(f"o_totalprice_{c}") for c in ("marked", "all", "diff", "percent")))


@query("SELECT c_custkey, round(CASE WHEN c_acctbal <= 0 THEN 0 ELSE 2 / (1 / c_acctbal + 1 / (c_nationkey + 1)) END, 6) AS h FROM customer")
@tables
def z15_positive_hmean(t):
    return t.customer.select("c_custkey", F.round(stats.positive_hmean([F.col("c_acctbal"), F.col("c_nationkey") + 1.0]), 6).alias("h"))


@query("SELECT count(*) AS rows, round(avg(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''))), 6) AS mean_tokens, round(sum(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''))) * 2e-6, 6) AS price FROM documents")
@tables
def z17_token_price(t):
    return stats.token_price(t.documents, "text", 2e-6).select("rows", F.round("mean_tokens", 6).alias("mean_tokens"), F.round("price", 6).alias("price"))


# generation and training


@query("SELECT s_suppkey, '## repository' || chr(10) || 'ex' || chr(10) || '## files' || chr(10) || 'a b' || chr(10) || '## tags' || chr(10) || '[x, y]' || chr(10) || '## repository' || chr(10) || s_name || chr(10) || '## files' || chr(10) || s_nationkey || chr(10) || '## 3 tags' || chr(10) || '[' AS prompt FROM supplier")
@tables
def l5_prompts(t):
    context = F.array(F.struct(F.lit("ex").alias("name"), F.lit("a b").alias("content"), F.lit("x, y").alias("true_text")))
    return t.supplier.select("s_suppkey", generation.tagged_prompt(context, F.col("s_name"), F.col("s_nationkey").cast("string")).alias("prompt"))


@query(f"WITH {_S} SELECT r AS repo_name, '```' AS answer, least(count(*), 10)::INT AS n_files, '' AS error FROM s GROUP BY 1")
@tables
def l1_readmes(t):
    """The offline generator gives a prompt's last line back."""
    got = generation.readmes(generation.file_summaries(t.sources(), 10))
    return got.select("repo_name", "answer", "n_files", F.coalesce("error", F.lit("")).alias("error"))


@query()
@tables
def flow_librarian(t):
    files = t.sources()
    signatures = flows.signatures_of_files(files)
    repos = files.groupBy(F.col("repo_name").alias("repo")).agg(F.array_sort(F.collect_set("path")).alias("tasks"))
    return flows.librarian(repos, signatures)


@query()
@tables
def e1_word2vec(t):
    docs = t.part.select("p_partkey", "p_name")
    model = embedding.train_word2vec(docs, "p_name", size=16, least=2)
    return embedding.embed(model, docs, "p_name").select("p_partkey", F.round(retrieval.dot(F.col("embedding"), F.col("embedding")), 3).alias("norm"))


@query()
@tables
def e5_clusters(t):
    return embedding.central_rows(embedding.clusters(t.embeddings, 5), "cluster", "vec_id", 3).withColumn("distance", F.round("distance", 6))


@query("SELECT conv_id, turn, coalesce(sum(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations")
@tables
def e9_batch_offsets(t):
    return embedding.batch_offsets(t.conversations.select("conv_id", "turn", X.tokenize(F.col("text")).alias("w")), "w", "turn", ["conv_id"]).select("conv_id", "turn", "start")


# extension: streams, here as a batch


@query("SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
@tables
def stream_windows(t):
    return streams.windowed(t.events).withColumn("total", F.round("total", 4))

"""Further registered queries: readers and writers as round trips through the shared folder, functions, variants and flows. Their DuckDB SQL says the same over the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.operators import code, distances, embedding, generation, graph, metrics, relational, retrieval, sampling, stats
from tesserae.plans import flows
from tesserae.plans.durable import shared_path
from tesserae.queries import _LEGACY, _S, EDGES, RANKED, REL, RES, RT, query, tables
from tesserae.sources import files

# readers and writers


def _round_trip(spark: SparkSession, df: DataFrame, end: str, schema: str | None = None) -> DataFrame:
    path = f"{shared_path(spark, 'files')}.{end}"
    files.write(df, path)
    return files.read(spark, path, schema)


_PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
_DOCS = "SELECT doc_id, source, md5(text) AS digest FROM documents"


def _digests(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "source", F.md5("text").alias("digest"))


@query("SELECT * FROM part")
@tables
def s2_csv_round_trip(t):
    return _round_trip(t._spark, t.part, "csv", _PART)


@query(_DOCS)
@tables
def k2_csv_of_texts(t):
    """Texts with line breaks, quotes and commas."""
    return _digests(_round_trip(t._spark, t.documents.select("doc_id", "source", "text"), "csv", "doc_id long, source string, text string"))


@query(_DOCS)
@tables
def k3_feather_round_trip(t):
    return _digests(_round_trip(t._spark, t.documents.select("doc_id", "source", "text"), "feather"))


@query(_DOCS)
@tables
def k4_parquet_round_trip(t):
    return _digests(_round_trip(t._spark, t.documents.select("doc_id", "source", "text"), "parquet"))


@query(_DOCS)
@tables
def k5_json_lines_round_trip(t):
    return _digests(_round_trip(t._spark, t.documents.select("doc_id", "source", "text"), "jsonl", "doc_id long, source string, text string"))


@query("SELECT vec_id || ' ' || array_to_string(list_transform(embedding, lambda x: printf('%.5f', x::DOUBLE)), ' ') AS value FROM embeddings")
@tables
def k6_word_vectors(t):
    return files.word_vectors(t.embeddings.withColumn("word", F.col("vec_id").cast("string")), vector="embedding")


@query("SELECT repo, 'r' || n AS text FROM (SELECT r_name AS repo, r_regionkey AS n FROM region)")
@tables
def s18_repo_map(t):
    """One JSON object on one line."""
    path = shared_path(t._spark, "map")
    entry = F.struct("r_name", F.concat(F.lit("r"), "r_regionkey"))
    t.region.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).coalesce(1).write.text(path)
    return files.repo_map(t._spark, path)


@query("SELECT s_suppkey, s_name, array_to_string(['a b', 'n' || s_nationkey], ';') AS tasks FROM supplier WHERE s_suppkey % 4 <> 0")
@tables
def s3_papers(t):
    """List literals in a CSV file; rows without a list are dropped."""
    tasks = F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("['a b', 'n"), "s_nationkey", F.lit("']")))
    path = f"{shared_path(t._spark, 'papers')}.csv"
    files.write(t.supplier.select("s_suppkey", "s_name", tasks.alias("tasks")), path)
    return files.papers(t._spark, path).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.array_join("tasks", ";").alias("tasks"))


@query("SELECT 'u' || s_suppkey AS paper_url, 'o/' || s_name AS repo, 't' || s_suppkey AS title, s_nationkey || ';x' AS tasks FROM supplier")
@tables
def s4_paper_dumps(t):
    """Two gzipped JSON dumps."""
    url = F.concat(F.lit("u"), "s_suppkey")
    links = t.supplier.select(url.alias("paper_url"), F.concat(F.lit("t"), "s_suppkey").alias("paper_title"), F.concat(F.lit("https://github.com/o/"), "s_name").alias("repo_url"))
    papers = t.supplier.select(url.alias("paper_url"), F.concat(F.lit("t"), "s_suppkey").alias("title"), F.array(F.col("s_nationkey").cast("string"), F.lit("x")).alias("tasks"))
    paths = [shared_path(t._spark, "dump") for _ in range(2)]
    for df, path in zip((links, papers), paths):
        df.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.option("compression", "gzip").text(path)
    found, dump = files.paper_dumps(t._spark, *paths)
    return found.join(dump, "paper_url").select("paper_url", "repo", "title", F.array_join("tasks", ";").alias("tasks"))


@query(f"WITH {_S} SELECT r AS repo, (SELECT max(s_name) FROM supplier WHERE 'r' || s_nationkey = r) AS readme, count(selected) AS selected FROM (SELECT r, CASE v WHEN 0 THEN 1 WHEN 1 THEN 1 END AS selected FROM s) GROUP BY 1")
@tables
def s5_repos_with_code(t):
    repos = t.supplier.groupBy(F.concat(F.lit("r"), "s_nationkey").alias("repo")).agg(F.max("s_name").alias("readme"))
    more = t.nation.select(F.concat(F.lit("none"), "n_nationkey").alias("repo"), F.lit("x").alias("readme"))
    kept, with_code = files.repos_with_code(repos.unionByName(more), t.sources())
    n = with_code.groupBy(F.col("repo_name").alias("repo")).agg(F.count("selected_code").alias("selected"))
    return kept.join(n, "repo")


@query("SELECT c_nationkey AS repo, c, s FROM (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
@tables
def s6_align_by_repo(t):
    c = t.customer.groupBy(F.col("c_nationkey").alias("repo")).agg(F.count("*").alias("c"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("repo")).agg(F.count("*").alias("s"))
    a, b = files.align_by_repo(c, s)
    return a.join(b, "repo")


@query("SELECT event_id AS i, event_type AS o FROM events WHERE user_id % 3 = 0 AND event_type <> 'error'")
@tables
def s7_traces(t):
    path = shared_path(t._spark, "traces")
    rows = t.events.select(
        F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("OK")).alias("status_code"), F.when(F.col("user_id") % 3 == 0, F.lit("f")).otherwise(F.lit("g")).alias("name"),
        F.to_json(F.struct(F.col("event_id").alias("i"))).alias("attributes.input.value"), F.to_json(F.struct(F.col("event_type").alias("o"))).alias("attributes.output.value"),
    )
    rows.write.parquet(path)
    return files.generated_traces(t._spark, path, "f", "i long", "o string")


@query("SELECT name, arg_min(topics, s_suppkey) AS topics FROM (SELECT s_suppkey, 'n' || s_nationkey AS name, s_name || ' x' AS topics FROM supplier) GROUP BY 1")
@tables
def s9_search_results(t):
    item = F.struct(F.concat(F.lit("n"), "s_nationkey").alias("name"), F.lit(None).cast("string").alias("description"), F.array("s_name", F.lit("x")).alias("topics"))
    raw = t.supplier.agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", item.alias("item")))), lambda x: x["item"]).alias("items"))
    return files.search_results(raw).select("name", "topics")


@query("SELECT doc_id, source, md5(text) AS digest FROM documents WHERE source IS NOT NULL")
@tables
def s15_splits(t):
    """JSON lines in three folders as one table."""
    paths = [shared_path(t._spark, "split") for _ in range(3)]
    for i, path in enumerate(paths):
        t.documents.where(F.col("doc_id") % 3 == i).select("doc_id", "source", "text").write.json(path)
    return _digests(files.splits(t._spark, paths, "doc_id long, source string, text string", ["source"]))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal, -1::INTEGER AS nation FROM customer WHERE c_name IS NOT NULL UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier")
@tables
def s16_feather_files(t):
    """Files of which each lacks a column."""
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    paths = [f"{shared_path(t._spark, 'files')}.feather" for _ in range(2)]
    for df, path in zip((a, b), paths):
        files.write(df, path)
    return files.read_all(t._spark, paths, ["name"]).select("id", "name", "bal", F.coalesce("nation", F.lit(-1)).alias("nation"))


@query("SELECT r AS repo_name, p AS path, md5(p || r) AS digest FROM (SELECT 'r' || s_nationkey AS r, 'src/s' || s_suppkey || '.py' AS p FROM supplier)")
@tables
def s1_python_files(t):
    path = f"{shared_path(t._spark, 'files')}.parquet"
    files.write(t.sources().unionByName(t.nation.select(F.lit(None).cast("string").alias("repo_name"), F.col("n_name").alias("path"), F.lit("").alias("content"))), path)
    return files.python_files(t._spark, path).select("repo_name", "path", F.md5(F.concat("path", "repo_name")).alias("digest"))


@query("SELECT doc_id // 7 AS file, sum(n)::BIGINT AS n FROM (SELECT doc_id, 1 AS n FROM documents) GROUP BY 1")
@tables
def s19_globbed_json(t):
    path = shared_path(t._spark, "glob")
    t.documents.select((F.col("doc_id") / 7).cast("long").alias("file"), F.lit(1).alias("n"), (F.col("doc_id") % 2).alias("half")).write.partitionBy("half").json(path)
    return files.splits(t._spark, [f"{path}/half=*"], "file long, n long").groupBy("file").agg(F.sum("n").alias("n"))


@query(f"WITH {EDGES} SELECT repo_name, source, target, edge_type FROM e WHERE edge_type = 'R'")
@tables
def k1_edges_by_type(t):
    """Edges written by type and read with partition pruning."""
    path = f"{shared_path(t._spark, 'edges')}.parquet"
    files.write(t.edges().drop("ordinal"), path, ["edge_type"])
    return files.read(t._spark, path).where("edge_type = 'R'").select("repo_name", "source", "target", "edge_type")


@query("SELECT r_name, r_regionkey FROM region")
@tables
def k8_table_text(t):
    """Parsed back from markdown."""
    text = files.table_text(t.region.select("r_name", "r_regionkey").orderBy("r_regionkey"))
    lines = t._spark.range(1).select(F.explode(F.slice(F.split(F.lit(text), "\n"), 3, 1000)).alias("l"))
    cells = F.split("l", r"\s*\|\s*")
    return lines.select(cells[1].alias("r_name"), cells[2].cast("int").alias("r_regionkey"))


# filters and joins


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey % 3 <> 0 AND s_suppkey % 4 <> 0")
@tables
def p8_dropna(t):
    df = t.supplier.select("s_suppkey", F.when(F.col("s_nationkey") % 3 != 0, F.col("s_name")).alias("s_name"), F.when(F.col("s_suppkey") % 4 != 0, F.lit(1)).alias("x"))
    return df.na.drop(subset=["s_name", "x"]).drop("x")


@query("SELECT s_name AS name_x, s_suppkey AS id_x, n_name AS nation FROM supplier JOIN nation ON n_nationkey = s_nationkey")
@tables
def p10_renamed_and_j2(t):
    """Keys of different names, the right one dropped; columns renamed and put in order."""
    j = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).drop("n_nationkey")
    return j.withColumnsRenamed({"s_suppkey": "id_x", "s_name": "name_x", "n_name": "nation"}).select("name_x", "id_x", "nation")


@query("SELECT p_partkey, p_brand || ' ' || p_type AS tags, p_name || ' x' AS names FROM part")
@tables
def p12_flatten_lists(t):
    df = t.part.select("p_partkey", F.array("p_brand", "p_type").alias("tags"), F.concat(F.lit("['"), "p_name", F.lit("', 'x']")).alias("names"))
    return X.flatten_lists(df, ["tags", "names"])


@query("SELECT vec_id::DOUBLE AS vec_id, label::DOUBLE AS label FROM embeddings")
@tables
def p13_numeric_without_vectors(t):
    df = relational.drop_vectors(t.embeddings.withColumn("name", F.lit("x")))
    return df.select(*(F.col(c).cast("double").alias(c) for c in relational.numeric_columns(df)))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
@tables
def j4_key_and_lookup(t):
    return relational.enrich(t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), t.nation, "n_nationkey", ["n_name"]).select("c_custkey", "n_name")


@query("SELECT s_nationkey AS k, count(*) AS suppliers, (SELECT count(*) FROM customer WHERE c_nationkey = s_nationkey) AS customers FROM supplier GROUP BY 1 HAVING (SELECT count(*) FROM customer WHERE c_nationkey = s_nationkey) > 0")
@tables
def j17_per_key(t):
    import pandas as pd

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [a["k"].iloc[0]], "suppliers": [len(a)], "customers": [len(b)]}) if len(a) and len(b) else pd.DataFrame({"k": [], "suppliers": [], "customers": []})

    return relational.per_key(t.supplier.select(F.col("s_nationkey").alias("k")), t.customer.select(F.col("c_nationkey").alias("k")), "k", both, "k int, suppliers long, customers long")


@query("SELECT l_suppkey AS a, l_partkey AS x FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1")
@tables
def w13_row_of_largest(t):
    top = relational.first_of_group(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")])
    return top.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("x"))


@query(f"WITH {RES} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, query_id)::INT AS place FROM res QUALIFY place <= 3")
@tables
def w7_top_by_column(t):
    return retrieval.similarity_top(t.results(), 3, "column")


@query(f"WITH {RES} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS place FROM res QUALIFY place <= 3")
@tables
def w7_top_by_row(t):
    return retrieval.similarity_top(t.results(), 3)


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name DESC")
@tables
def w11_sorted(t):
    return t.nation.select("n_nationkey", "n_name").orderBy(F.desc("n_name"))


@query("SELECT s_suppkey, s_acctbal FROM supplier")
@tables
def u5_columns_without(t):
    return relational.columns_without(t.supplier, t.supplier.select("s_name", "s_nationkey"))


@query("WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS position FROM nation), b AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS position FROM region) SELECT position, n_name, r_name FROM a JOIN b USING (position)")
@tables
def u6_by_position(t):
    return relational.by_position(t.nation, t.region, "n_nationkey", "r_regionkey").select("position", "n_name", "r_name")


# functions


@query("SELECT p_partkey, lower(p_brand) || ' ' || lower(p_type) AS names FROM part")
@tables
def f2_lower_all(t):
    return t.part.select("p_partkey", F.array_join(X.lower_all(F.array("p_brand", "p_type")), " ").alias("names"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name || ' ' END || p_brand AS modules FROM part")
@tables
def f7_public_modules(t):
    return t.part.select("p_partkey", X.public_modules(F.array(F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("_")).otherwise(F.lit("")), "p_name"), "p_brand")).alias("modules"))


@query("SELECT p_partkey, p_brand || ', ' || p_name AS tags, 'r' || p_size AS repo, 'PROMPT ' || p_brand || ', ,' || p_name || chr(10) || '## rest' AS generated_text, (p_size % 2)::INT AS generation FROM part")
@tables
def m16_postprocessed(t):
    """Also F8: prompts, headings and runs of commas go."""
    raw = F.concat(F.lit("PROMPT "), "p_brand", F.lit(", ,"), "p_name", F.lit("\n## rest"))
    records = t.part.select("p_partkey", F.struct(F.concat(F.lit("r"), "p_size").alias("name"), F.col("p_type").alias("true_text")).alias("prompt_info"), F.array(raw).alias("generated_text"), F.lit("PROMPT ").alias("input_text"), (F.col("p_size") % 2).alias("generation"))
    out = metrics.postprocess_generations(records.withColumn("prompt_info", F.col("prompt_info").withField("key", F.col("p_partkey"))))
    return out.select(F.col("prompt_info.key").alias("p_partkey"), F.col("tasks").alias("tags"), "repo", "generated_text", "generation")


@query("SELECT p_partkey, p_brand || ' ; ' || p_type AS tags FROM part")
@tables
def f10_join_tags(t):
    return t.part.select("p_partkey", X.join_tags(F.concat("p_brand", F.lit(" , "), "p_type")).alias("tags"))


@query("SELECT s_suppkey, 'x' || s_suppkey || '.py y.py' AS files FROM supplier")
@tables
def f11_select_dependencies(t):
    paths = F.array(F.lit("a/__init__.py"), F.concat(F.lit("a/b/x"), "s_suppkey", F.lit(".py")), F.lit("y.py"), F.lit("c/z.py"))
    return t.supplier.select("s_suppkey", F.array_join(X.select_dependencies(paths, 2), " ").alias("files"))


@query("SELECT s_suppkey, s_name || ' n' || s_nationkey AS text FROM supplier")
@tables
def f12_names_text(t):
    return t.supplier.select("s_suppkey", X.names_text(F.array(F.struct(F.col("s_name").alias("name")), F.struct(F.concat(F.lit("n"), "s_nationkey").alias("name")))).alias("text"))


@query("WITH g AS (SELECT l_suppkey, l_returnflag AS f, list(l_partkey ORDER BY l_orderkey, l_linenumber) AS l FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, array_to_string(list_concat(list_concat(coalesce((SELECT l[1:5] FROM g x WHERE x.l_suppkey = s.l_suppkey AND f = 'A'), []), coalesce((SELECT l[1:5] FROM g x WHERE x.l_suppkey = s.l_suppkey AND f = 'N'), [])), coalesce((SELECT l[1:5] FROM g x WHERE x.l_suppkey = s.l_suppkey AND f = 'R'), []))[1:12], ' ') AS parts FROM (SELECT DISTINCT l_suppkey FROM lineitem) s")
@tables
def f15_select_elements(t):
    """Also G9: lists of three relations side by side, the first five of each, twelve at most."""
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == f, F.struct("l_orderkey", "l_linenumber", "l_partkey")))), lambda s: s["l_partkey"]).alias(f) for f in "ANR"]
    return t.lineitem.groupBy("l_suppkey").agg(*lists).select("l_suppkey", F.array_join(X.select_elements([F.col(f) for f in "ANR"], 5, 12).cast("array<string>"), " ").alias("parts"))


@query("SELECT s_suppkey, 'a' AS key, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'b', 'second' FROM supplier")
@tables
def f16_merge_first_wins(t):
    m = X.merge_first_wins([F.create_map(F.lit("a"), "s_name"), F.create_map(F.lit("a"), F.lit("no"), F.lit("b"), F.lit("second"))])
    return t.supplier.select("s_suppkey", F.explode(m).alias("key", "value"))


@query("SELECT event_id, round(value, 1) AS a, round(value / 7, 3) AS b FROM events")
@tables
def f17_round_nested(t):
    nested = F.struct(F.col("value").alias("a"), F.struct((F.col("value") / 7).alias("b")).alias("deep"))
    df = t.events.select("event_id", nested.alias("n"), F.round("value", 1).alias("a"))
    return df.select("event_id", "a", X.round_nested(F.col("n"), df.schema["n"].dataType)["deep"]["b"].alias("b"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 'Infinity'::DOUBLE ELSE round(1.0 / c_nationkey, 9) END AS r FROM customer")
@tables
def f20_reciprocal(t):
    return t.customer.select("c_custkey", F.round(X.reciprocal(F.col("c_nationkey")), 9).alias("r"))


@query("SELECT event_type, count(*) AS n, CASE event_type WHEN 'click' THEN 'BM25' WHEN 'view' THEN 'MPNet' ELSE 'some ' || replace(event_type, '_', ' ') END AS label FROM events GROUP BY 1")
@tables
def f22_labels(t):
    """Types of events stand for retrievers."""
    kind = F.col("event_type")
    name = F.when(kind == "click", F.lit("bm25")).when(kind == "view", F.lit("x/all-mpnet-base-v2")).otherwise(F.concat(F.lit("some_"), kind))
    return t.events.withColumn("retriever", name).groupBy("event_type", X.retriever_label(F.col("retriever")).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, 'a/s' || s_suppkey || '.py b.py' AS names FROM supplier")
@tables
def f25_file_lines(t):
    text = F.concat(F.lit("a/s"), "s_suppkey", F.lit(".py:\n  def f\n b.py:\nnone.txt"))
    return t.supplier.select("s_suppkey", F.array_join(X.file_lines(text), " ").alias("names"))


@query("SELECT page_id, replace(concat_ws(' ', url, 'x/y'), '/', ' ') AS text FROM pages")
@tables
def f27_document_text(t):
    return t.pages.select("page_id", X.document_text([F.col("url"), F.lit("x/y")]).alias("text"))


@query("SELECT s_suppkey, ' ' || s_name AS last, s_name || ' ' AS first FROM supplier")
@tables
def f29_piece_after(t):
    return t.supplier.select("s_suppkey", X.piece_after(F.concat(F.lit("a tags b tags "), "s_name"), "tags").alias("last"), X.piece_after(F.concat("s_name", F.lit(" repository b")), "repository", 1).alias("first"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) < 50 AS ok, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 THEN 'too large' END AS error FROM events")
@tables
def f31_outcome(t):
    k = F.from_json("props", "k long")["k"]
    return t.events.select("event_id", X.outcome(F.when(k < 50, k), F.lit("too large")).alias("o")).select("event_id", "o.ok", "o.error")


# samples


@query("SELECT doc_id FROM documents ORDER BY md5('5:' || doc_id), doc_id LIMIT 40")
@tables
def x16_sample_rows(t):
    return sampling.sample_rows(t.documents, 40, "doc_id", 5).select("doc_id")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY 1 ORDER BY md5(p_partkey::VARCHAR), p_partkey) <= round(count(*) OVER () * 0.3) AS test FROM part")
@tables
def x15_fraction(t):
    return sampling.stratified_split(t.part.withColumn("all", F.lit(1)), ["all"], "p_partkey", 0.3).select("p_partkey", "test")


@query("WITH rel AS (SELECT DISTINCT o_custkey::VARCHAR AS query_id, l_partkey::VARCHAR AS doc_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') SELECT query_id, md5(string_agg(doc_id, ' ' ORDER BY doc_id)) AS digest FROM rel WHERE query_id LIKE '%1%' GROUP BY 1 HAVING count(*) >= 3")
@tables
def x12_retrieval_dataset(t):
    rel = sampling.filter_queries(sampling.frequent_queries(t.qrels(), 3), F.col("query_id").contains("1"))
    return sampling.relevance(rel).select("query_id", F.md5(F.array_join(F.map_keys("results"), " ")).alias("digest"))


@query(f"WITH {RT}, p AS (SELECT repo, min(task) AS least_common_task FROM rt GROUP BY 1), n AS (SELECT least_common_task FROM p GROUP BY 1 HAVING count(*) >= 20) SELECT * FROM p WHERE least_common_task IN (SELECT * FROM n)")
@tables
def x22_small_tasks_dropped(t):
    return sampling.small_tasks_dropped(t.repos().select("repo", F.array_min("tasks").alias("least_common_task")), 20).select("repo", "least_common_task")


@query(f"WITH {RT}, p AS (SELECT 'u/o' || repo AS repo, repo AS k, min(task) AS least FROM rt GROUP BY repo), has AS (SELECT 'u/o' || l_orderkey AS repo, string_agg(DISTINCT 'p' || l_partkey, ' ' ORDER BY 'p' || l_partkey) AS d FROM lineitem GROUP BY 1), r AS (SELECT p.*, d FROM p JOIN has USING (repo) WHERE k % 3 <> 0), kept AS (SELECT * FROM r WHERE least IN (SELECT least FROM r GROUP BY 1 HAVING count(*) >= 5)), tc AS (SELECT task FROM rt JOIN kept ON kept.k = rt.repo GROUP BY 1 HAVING count(*) >= 5) SELECT kept.repo, least AS least_common_task, md5(d) AS records, (SELECT string_agg(task, ' ' ORDER BY task) FROM rt WHERE rt.repo = kept.k AND task IN (SELECT task FROM tc)) AS tasks FROM kept")
@tables
def x23_with_features(t):
    name = F.concat(F.lit("u/o"), "repo")
    papers = t.repos().select(name.alias("repo"), "tasks", F.array_min("tasks").alias("least_common_task"), F.lit("x").alias("readme"), F.when(F.col("repo") % 3 != 0, F.lit("y")).alias("abstract"))
    nodes = t.lineitem.select(F.concat(F.lit("o"), "l_orderkey").alias("node"))
    edges = t.lineitem.select(F.concat(F.lit("u/o"), "l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    out = sampling.with_features(papers, nodes, edges, 5)
    return out.select("repo", "least_common_task", F.md5("dependency_records").alias("records"), F.array_join("tasks", " ").alias("tasks"))


# code and graphs


@query(f"WITH {_LEGACY} SELECT count(*) AS unparsed, r AS repo_name FROM s WHERE v = 2 GROUP BY r UNION ALL SELECT 0, r FROM s GROUP BY r HAVING count(*) FILTER (WHERE v = 2) = 0")
@tables
def t1_unparsed(t):
    return code.unparsed(t.sources())


@query("SELECT 'repo:' || chr(10) || 'r' || s_suppkey || chr(10) || 'tasks:' || chr(10) || s_name || chr(10) || 'important nodes:' || chr(10) || 'sig' || s_nationkey AS repository_signature, 'r' || s_suppkey AS repo FROM supplier")
@tables
def g8_expanded_signatures(t):
    df = t.supplier.select(F.concat(F.lit("r"), "s_suppkey").alias("repo"), F.col("s_name").alias("tasks"), F.concat(F.lit("sig"), "s_nationkey").alias("dependency_signature"))
    return graph.expanded_signatures(df.union(df)).select("repo", "repository_signature")


@query("WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'o' || (l_orderkey // 400) AS b FROM lineitem WHERE l_quantity > 49), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c AS (SELECT a AS node, a AS m FROM u UNION SELECT u.b, c.m FROM c JOIN u ON u.a = c.node) SELECT node, min(m) AS component FROM c GROUP BY 1")
@tables
def g11_components(t):
    e = t.lineitem.where("l_quantity > 49").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("o"), F.floor(F.col("l_orderkey") / 400)).alias("target"))
    return graph.components(e)


@query(f"WITH {EDGES}, one AS (SELECT source, target FROM e WHERE repo_name = 1), ids AS (SELECT node, row_number() OVER (ORDER BY substr(md5(node), 1, 3), node) - 1 AS id FROM (SELECT source AS node FROM one UNION SELECT target FROM one)) SELECT DISTINCT s.id AS source_id, t.id AS target_id FROM one JOIN ids s ON s.node = source JOIN ids t ON t.node = target")
@tables
def g13_subgraph(t):
    return graph.subgraph(t.edges(), 1)


@query("WITH RECURSIVE u AS (SELECT DISTINCT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION SELECT DISTINCT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), b AS (SELECT a, b FROM u UNION SELECT b, a FROM u), w AS (SELECT 'r' || r_regionkey AS source, 'r' || r_regionkey AS node, 0 AS distance FROM region UNION SELECT source, b.b, distance + 1 FROM w JOIN b ON b.a = w.node WHERE distance < 3) SELECT source, node, min(distance)::INT AS distance FROM w GROUP BY 1, 2")
@tables
def g14_shortest_paths(t):
    e = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target"))
    e = e.union(t.nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    return distances.shortest_paths(e, t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("node")))


@query(f"WITH {EDGES}, deg AS (SELECT repo_name, node, count(*)::DOUBLE AS centrality_score FROM (SELECT DISTINCT repo_name, source, target, source AS node FROM e UNION ALL SELECT DISTINCT repo_name, source, target, target FROM e) GROUP BY 1, 2), first AS (SELECT repo_name, node, min(place) AS place FROM (SELECT repo_name, source AS node, 2 * ordinal AS place, edge_type FROM e UNION ALL SELECT repo_name, target, 2 * ordinal + 1, edge_type FROM e) WHERE edge_type IN ('A', 'N') GROUP BY 1, 2) SELECT repo_name, node, centrality_score FROM deg JOIN first USING (repo_name, node) QUALIFY row_number() OVER (PARTITION BY repo_name ORDER BY centrality_score DESC, place, node) <= 7")
@tables
def w4_central_nodes(t):
    return graph.centralities(t.edges(), ["A", "N"], 7, method="degree").select("repo_name", "node", "centrality_score")


# retrieval

_UNIT = "u AS (SELECT vec_id, list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) AS d FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings))"


@query("WITH d AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents), q AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark), w AS (SELECT doc_id, term, count(*)::DOUBLE AS w FROM d GROUP BY 1, 2), v AS (SELECT item_id, term, count(*)::DOUBLE AS v FROM q GROUP BY 1, 2) SELECT item_id AS query_id, doc_id, sum(v * w) AS score FROM v JOIN w USING (term) GROUP BY 1, 2")
@tables
def r3_sparse_dot(t):
    def weights(df, key, name):
        rows = df.select(F.col(key).alias(name), F.explode(retrieval.terms(F.col("text"))).alias("term"))
        return rows.groupBy(name, "term").agg(F.count("*").cast("double").alias("weight"))

    return retrieval.sparse_dot(weights(t.documents, "doc_id", "doc_id"), weights(t.benchmark, "item_id", "query_id"))


_HALVES = "h AS (SELECT vec_id, [list_transform(embedding[1:len(embedding) // 2], lambda x: x::DOUBLE), list_transform(embedding[len(embedding) // 2 + 1:2 * (len(embedding) // 2)], lambda x: x::DOUBLE)] AS v FROM embeddings)"


@query(f"WITH {_HALVES}, t AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM h), s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, a.i, max(list_dot_product(a.x, b.x)) AS m FROM t a, t b WHERE a.vec_id % 50 = 0 GROUP BY 1, 2, 3), r AS (SELECT query_id, doc_id, sum(m) AS score FROM s GROUP BY 1, 2) SELECT query_id, doc_id, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10")
@tables
def r3_late_interaction(t):
    """A vector's halves stand for the vectors of two tokens."""
    half = F.floor(F.size("embedding") / 2).cast("int")
    d = t.embeddings.select("vec_id", F.array(F.slice("embedding", F.lit(1), half), F.slice("embedding", half + 1, half)).alias("vectors"))
    q = d.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vectors")
    return retrieval.late_interaction(d.withColumnRenamed("vec_id", "doc_id"), q, 10).withColumn("score", F.round("score", 6))


@query(f"WITH {RES}, w AS (SELECT query_id, min(doc_id) AS doc_id FROM res GROUP BY 1), k AS (SELECT query_id, doc_id FROM res QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20) SELECT count(*) AS queries, avg(CASE WHEN k.doc_id IS NULL THEN 0 ELSE 1 END) AS recall FROM w LEFT JOIN k USING (query_id, doc_id)")
@tables
def r11_recall(t):
    return retrieval.recall_at(t.results(), t.results().groupBy("query_id").agg(F.min("doc_id").alias("doc_id")), 20)


_PART_HITS = "docs AS (SELECT p_partkey::VARCHAR AS doc_id, c AS columns, string_split(CASE c WHEN 'name' THEN p_name ELSE p_name || chr(10) || p_type END, chr(10)) AS l FROM part, (VALUES ('name'), ('both')) v(c)), w AS (SELECT doc_id, columns, lower(unnest(string_split(array_to_string(l, ' '), ' '))) AS term FROM docs), q AS (SELECT DISTINCT lower(p_type) AS query_id FROM part), res AS (SELECT columns, query_id, doc_id, count(*)::DOUBLE AS score FROM w JOIN q ON term = query_id GROUP BY 1, 2, 3), rk AS (SELECT *, row_number() OVER (PARTITION BY columns, query_id ORDER BY score DESC, doc_id) AS r FROM res), rel AS (SELECT p_partkey::VARCHAR AS doc_id, lower(p_type) AS query_id FROM part WHERE p_size > 25)"


def _overlap(docs: DataFrame, queries: DataFrame) -> DataFrame:
    q = queries.select("query_id", F.col("query").alias("term"))
    return docs.select("doc_id", F.explode(F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " ")).alias("term")).join(q, "term").groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score"))


def _part_search(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = F.col("p_partkey").cast("string").alias("doc_id")
    qs = t.part.select(F.lower("p_type").alias("query_id"), F.lower("p_type").alias("query")).distinct()
    return t.part.select(key, "p_name", "p_type", "p_size"), qs, t.part.where("p_size > 25").select(F.lower("p_type").alias("query_id"), key, F.lit(1).alias("rel"))


_HITS = ", ".join(f'(count(*) FILTER (WHERE rel.doc_id IS NOT NULL AND r <= {k}))::DOUBLE AS "Hits@{k}"' for k in metrics.KS)
_HIT_NAMES = [f"Hits@{k}" for k in metrics.KS]


@query(f"WITH {_PART_HITS} SELECT columns, 'overlap' AS retriever, rk.query_id, {_HITS} FROM rk LEFT JOIN rel ON rel.doc_id = rk.doc_id AND rel.query_id = rk.query_id WHERE r <= 100 GROUP BY 1, 2, 3")
@tables
def m14_experiment_grid(t):
    docs, qs, rel = _part_search(t)
    got = metrics.experiment_grid(docs, rel, qs, {"name": ["p_name"], "both": ["p_name", "p_type"]}, {"overlap": _overlap})
    return got.select("columns", "retriever", "query_id", *(F.col(f"`{c}`") for c in _HIT_NAMES))


@query(f"WITH {_PART_HITS} SELECT columns AS corpus, 'overlap' AS retriever, rk.query_id, {_HITS} FROM rk LEFT JOIN rel ON rel.doc_id = rk.doc_id AND rel.query_id = rk.query_id WHERE r <= 50 GROUP BY 1, 2, 3")
@tables
def r12_corpora_by_retrievers(t):
    docs, qs, rel = _part_search(t)
    corpus = docs.select(F.lit("name").alias("corpus"), "doc_id", F.col("p_name").alias("text")).union(docs.select(F.lit("both"), "doc_id", F.concat_ws("\n", "p_name", "p_type")))
    return flows.evaluate(corpus, qs, rel, {"overlap": _overlap}, 50).select("corpus", "retriever", "query_id", *(F.col(f"`{c}`") for c in _HIT_NAMES))


@query(f"WITH {_PART_HITS}, parts AS (SELECT doc_id, p_size % 2 AS generation FROM docs JOIN part ON p_partkey::VARCHAR = doc_id WHERE columns = 'both'), rg AS (SELECT generation, query_id, res.doc_id, row_number() OVER (PARTITION BY generation, query_id ORDER BY score DESC, res.doc_id) AS r FROM res JOIN parts ON parts.doc_id = res.doc_id WHERE columns = 'both') SELECT generation::INT AS generation, rg.query_id, {_HITS} FROM rg LEFT JOIN rel ON rel.doc_id = rg.doc_id AND rel.query_id = rg.query_id GROUP BY 1, 2")
@tables
def r13_by_generation(t):
    docs, qs, rel = _part_search(t)

    def evaluate(rows: DataFrame) -> DataFrame:
        return metrics.per_query(_overlap(rows.select("doc_id", F.concat_ws("\n", "p_name", "p_type").alias("text")), qs), rel)

    got = metrics.by_generation(docs.withColumn("generation", F.col("p_size") % 2), evaluate, [0, 1])
    return got.select("generation", "query_id", *(F.col(f"`{c}`") for c in _HIT_NAMES))


# measures


@query("WITH c AS (SELECT s_suppkey AS d, 'a' AS c FROM supplier UNION ALL SELECT s_suppkey, 'b' FROM supplier UNION ALL SELECT c_custkey, 'c' FROM customer WHERE c_nationkey < 12), g AS (SELECT d, count(DISTINCT c) AS c, count(*) AS r FROM c GROUP BY 1) SELECT sum(r)::BIGINT AS rows, count(*) AS documents, count(*) FILTER (WHERE c = 3) AS in_all, count(*) = count(*) FILTER (WHERE c = 3) AS same FROM g")
@tables
def c5_same_documents(t):
    """Two corpora of suppliers, and one of customers, whose keys are partly the same."""
    corpus = metrics.corpora(t.supplier.withColumnRenamed("s_suppkey", "repo"), {"name": ["s_name"], "all": ["s_name", "s_nationkey"]})
    third = metrics.corpora(t.customer.where("c_nationkey < 12").withColumnRenamed("c_custkey", "repo"), {"customers": ["c_name"]})
    return metrics.documents_in_all(corpus.unionByName(third))


@query(f"WITH {RT}, n AS (SELECT repo FROM rt GROUP BY 1 HAVING count(*) <= 6) SELECT 'only' AS corpus, repo AS doc_id, 'o' || repo AS text FROM n")
@tables
def c4_limited_corpora(t):
    return metrics.corpora(t.repos().withColumn("name", F.concat(F.lit("o"), "repo")), {"only": ["name"]}, most_tasks=6).select("corpus", "doc_id", "text")


@query(f"WITH {RANKED}, s AS (SELECT query_id, (count(*) FILTER (WHERE hit AND r <= 5))::DOUBLE AS hits FROM rk GROUP BY 1), q AS (SELECT DISTINCT o_custkey::VARCHAR AS query_id, 'c' || o_custkey AS query FROM orders) SELECT coalesce(s.query_id, q.query_id) AS query_id, hits, query FROM s FULL JOIN q ON s.query_id = q.query_id")
@tables
def m5_with_query_text(t):
    scores = metrics.per_query(t.results(), t.qrels(), (5,)).select("query_id", F.col("`Hits@5`").alias("hits"))
    qs = t.orders.select(F.col("o_custkey").cast("string").alias("query_id"), F.concat(F.lit("c"), "o_custkey").alias("query")).distinct()
    return metrics.with_query_text(scores, qs)


@query(f"WITH {RES}, {REL}, top AS (SELECT query_id, doc_id FROM res QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3) SELECT count(top.doc_id) / count(*) AS accuracy FROM rel LEFT JOIN top USING (query_id, doc_id)")
@tables
def m12_topk_label_accuracy(t):
    scores = t.results().select(F.col("query_id").alias("sample"), F.col("doc_id").alias("label"), "score")
    return metrics.topk_label_accuracy(scores, t.qrels().select(F.col("query_id").alias("sample"), F.col("doc_id").alias("label")), 3)


@query("WITH p AS (SELECT p_partkey, p_name || ' ' || p_type AS reference, p_type || ' ' || p_brand AS generated FROM part) SELECT p_partkey, round(list_cosine_similarity([length(reference)::DOUBLE, 1.0, strlen(reference) % 7], [length(generated)::DOUBLE, 1.0, strlen(generated) % 7]), 6) AS similarity FROM p")
@tables
def m8_similarity(t):
    """The embedding is a parameter; here one that SQL has too."""
    df = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("reference"), F.concat_ws(" ", "p_type", "p_brand").alias("generated"))
    got = metrics.generation_metrics(df, "p_partkey", embed=lambda c: F.array(F.length(c).cast("double"), F.lit(1.0), (F.octet_length(c) % 7).cast("double")))
    return got.select("p_partkey", F.round("similarity", 6).alias("similarity"))


@query("SELECT generation, r, n FROM (SELECT (o_orderkey % 2)::VARCHAR AS generation, o_orderstatus AS r, o_custkey AS n FROM orders)")
@tables
def m15_from_generations(t):
    rows = t.orders.select((F.col("o_orderkey") % 2).cast("string").alias("g"), F.struct(F.col("o_orderstatus").alias("r"), F.col("o_custkey").alias("n")).alias("s"))
    return metrics.from_generations(rows.groupBy("g").agg(F.collect_list("s").alias("l")).agg(F.map_from_entries(F.collect_list(F.struct("g", "l"))).alias("records")))


@query("SELECT event_type, event_id, metric, v FROM (SELECT event_type, event_id, 'value' AS metric, value AS v FROM events UNION ALL SELECT event_type, event_id, 'user_id', user_id::DOUBLE FROM events)")
@tables
def z16_long_metrics(t):
    df = t.events.select("event_type", "event_id", "value", F.col("user_id").cast("double").alias("user_id"))
    return metrics.long_metrics(df, ["event_type", "event_id"], ["value", "user_id"]).withColumnRenamed("value", "v")


@query(f"WITH {RT}, g AS (SELECT task AS query, avg(CASE WHEN o_orderstatus = 'P' THEN (SELECT max(o_totalprice) FROM orders WHERE o_orderstatus <> 'P') ELSE o_totalprice END) AS wmd FROM rt JOIN orders ON o_orderkey = repo GROUP BY 1), i AS (SELECT p_brand AS query, avg(p_size) AS size FROM part GROUP BY 1) SELECT query, round(wmd, 4) AS wmd, round(size, 6) AS size FROM g JOIN i USING (query)")
@tables
def z16_merged_metrics(t):
    made = t.repos().join(t.orders, F.col("o_orderkey") == F.col("repo")).select(F.col("tasks").alias("true_tasks"), F.when(F.col("o_orderstatus") == "P", F.lit(float("inf"))).otherwise(F.col("o_totalprice")).alias("wmd"))
    ir = t.part.select(F.col("p_brand").alias("query"), F.col("p_size").alias("size"))
    return metrics.per_query_with_generation(made, ir, clipped="wmd").select("query", F.round("wmd", 4).alias("wmd"), F.round("size", 6).alias("size"))


# statistics


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS q, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS p, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS d FROM lineitem) SELECT 'l_quantity' AS left, 'l_discount' AS right, round(corr(q, d), 6) AS value FROM r UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(p, d), 6) FROM r")
@tables
def z1_correlation_table(t):
    return stats.correlation_table(t.lineitem, ["l_quantity", "l_extendedprice"], ["l_discount"]).withColumn("value", F.round("value", 6))


@query("SELECT DISTINCT value, round(cume_dist() OVER (ORDER BY value), 9) AS share FROM events")
@tables
def z12_ecdf(t):
    return stats.ecdf(t.events, "value").select("value", F.round("share", 9).alias("share"))


@query("SELECT i / 10 AS q, round(a[i + 1], 6) AS a, round(b[i + 1], 6) AS b FROM (SELECT quantile_cont(value, [" + ", ".join(str(i / 10) for i in range(11)) + "]) FILTER (WHERE event_type = 'click') AS a, quantile_cont(value, [" + ", ".join(str(i / 10) for i in range(11)) + "]) FILTER (WHERE event_type <> 'click') AS b FROM events), range(11) s(i)")
@tables
def z12_qq(t):
    return stats.qq(t.events.where("event_type = 'click'"), t.events.where("event_type <> 'click'"), "value", 10).select("q", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("SELECT round(sum(CASE WHEN y = 1 THEN below + same / 2 END) / (max(p) * max(n)::DOUBLE), 9) AS auc FROM (SELECT y, sum(1 - y) OVER (ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(1 - y) OVER (PARTITION BY s) AS below, sum(1 - y) OVER (PARTITION BY s) AS same, sum(y) OVER () AS p, sum(1 - y) OVER () AS n FROM (SELECT (l_returnflag = 'R')::INT AS y, l_quantity AS s FROM lineitem))")
@tables
def z14_roc_area(t):
    return stats.roc_area(t.lineitem.select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y")), "l_quantity", "y").select(F.round("auc", 9).alias("auc"))


@query("SELECT DISTINCT s AS threshold, round((sum(1 - y) OVER (ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / sum(1 - y) OVER (), 9) AS fpr, round((sum(y) OVER (ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / sum(y) OVER (), 9) AS tpr FROM (SELECT (l_returnflag = 'R')::INT AS y, l_quantity AS s FROM lineitem)")
@tables
def z14_roc_curve(t):
    got = stats.roc_curve(t.lineitem.select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y")), "l_quantity", "y")
    return got.select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query()
@tables
def z14_logistic_regression(t):
    """Fitted; tests hold its score equations at zero."""
    df = t.lineitem.select((F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), (F.col("l_extendedprice") > 40000).cast("int").alias("y"))
    return stats.logistic_regression(df, ["q", "d"], "y").withColumn("coefficient", F.round("coefficient", 3))


# generation and training


@query(f"WITH {_S}, b2 AS (SELECT r, p, row_number() OVER (PARTITION BY r ORDER BY p) AS i FROM s) SELECT r AS repo_name, string_agg(p, ' ' ORDER BY i) AS filenames, count(*)::INT AS n_files FROM b2 WHERE i <= 3 GROUP BY 1")
@tables
def l3_file_summaries(t):
    return generation.file_summaries(t.sources(), 3).select("repo_name", F.array_join("filenames", " ").alias("filenames"), "n_files")


@query("SELECT 'r' || s_suppkey AS repo_name, 'a/s' || s_suppkey || '.py' AS filenames, 1::INT AS n_files FROM supplier")
@tables
def l7_map_summaries(t):
    maps = t.supplier.select(F.concat(F.lit("r"), "s_suppkey").alias("repo"), F.concat(F.lit("a/s"), "s_suppkey", F.lit(".py:\n  def f")).alias("text"))
    return generation.map_summaries(maps).select("repo_name", F.array_join("filenames", " ").alias("filenames"), "n_files")


@query(f"WITH {_S}, f AS (SELECT r, p, row_number() OVER (PARTITION BY r ORDER BY p) AS i FROM s) SELECT variant, r AS repo_name, least(count(*), 4)::INT AS n_files FROM f, (VALUES ('code_summary'), ('code_flat'), ('map_summary'), ('map_flat'), ('signature_summary'), ('signature_flat')) v(variant) GROUP BY 1, 2")
@tables
def l4_readme_variants(t):
    s = t.sources()
    names = F.array_sort(F.collect_list("path"))
    by = s.groupBy(F.col("repo_name").alias("repo")).agg(F.slice(names, 1, 4).alias("n"))
    maps = by.select("repo", F.concat(F.array_join("n", ":\n"), F.lit(":")).alias("text"))
    signatures = by.select("repo", F.concat(F.lit("repo: x\n\nrepo-file:\n"), F.array_join("n", ", ")).alias("dependency_signature"))
    return generation.readme_variants(s, maps, signatures, 4).select("variant", "repo_name", "n_files")


@query("SELECT s_suppkey, generation, 'tag ' || s_name AS generated_text FROM supplier, (VALUES (0::INT), (1::INT), (2::INT)) g(generation)")
@tables
def l6_generations(t):
    return generation.generations(t.supplier.select("s_suppkey", F.concat(F.lit("one\ntag "), "s_name").alias("p")), 3, "p").select("s_suppkey", "generation", "generated_text")


@query("SELECT s_suppkey, 'say' || chr(10) || chr(10) || 'sig a' || chr(10) || 'tasks:' || chr(10) || 't1' || chr(10) || chr(10) || s_name || chr(10) || 'tasks:' || chr(10) AS prompt FROM supplier")
@tables
def l8_few_shot_prompts(t):
    context = F.array(F.struct(F.lit("sig a").alias("signature"), F.lit("t1").alias("tasks")))
    return t.supplier.select("s_suppkey", generation.few_shot_prompt(context, F.col("s_name"), "say").alias("prompt"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'a;b' || s_nationkey END AS tags FROM supplier")
@tables
def l9_typed_tags(t):
    answer = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('{"tasks": ["a", "b'), "s_nationkey", F.lit('"]}'))).otherwise(F.lit("no JSON"))
    return t.supplier.select("s_suppkey", F.array_join(generation.typed_tags(answer), ";").alias("tags"))


_WORDS = "SELECT p_partkey, len(list_filter(regexp_split_to_array(p_name, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''))::INT AS words, 8::INT AS size, 0.0::DOUBLE AS gap FROM part"


def _gap(df: DataFrame, other: DataFrame) -> DataFrame:
    """The largest difference of a component of two tables' embeddings (p_partkey, embedding), with the number of words."""
    both = df.join(other.select("p_partkey", F.col("embedding").alias("_e")), "p_partkey")
    gap = F.array_max(F.zip_with("embedding", "_e", lambda x, y: F.abs(x - y)))
    return both.select("p_partkey", F.size(X.tokenize(F.col("p_name"))).alias("words"), F.size("embedding").alias("size"), (F.round(F.coalesce(gap, F.lit(0.0)), 6) + 0.0).alias("gap"))


@query(_WORDS)
@tables
def k7_saved_model(t):
    """A model saved and loaded again gives the vectors that it gave before."""
    docs = t.part.select("p_partkey", "p_name")
    model = embedding.train_word2vec(docs, "p_name", size=8, least=1)
    path = shared_path(t._spark, "model")
    embedding.save_model(model, path)
    return _gap(embedding.embed(embedding.load_word2vec(path), docs, "p_name"), embedding.embed(model, docs, "p_name"))


@query(_WORDS)
@tables
def e2_embedded_texts(t):
    """A text's vector is the mean of its words' vectors."""
    docs = t.part.select("p_partkey", "p_name")
    model = embedding.train_word2vec(docs, "p_name", size=8, least=1)
    split = docs.select("p_partkey", F.explode(X.tokenize(F.col("p_name"))).alias("word"))
    words = split.join(embedding.vectors(model).withColumnRenamed("vector", "embedding"), "word")
    # a text's words are few, so that its sums are made where they are dealt
    words = relational.dealt(words, split.count(), "p_partkey")
    return _gap(embedding.embed(model, docs, "p_name"), retrieval.mean_vector(words, ["p_partkey"]))


@query(f"WITH {_LEGACY} SELECT repo, source AS file, string_agg(DISTINCT destination, ' ' ORDER BY destination) AS functions, 't' || repo AS task FROM le WHERE edge_type = 'file-function' GROUP BY 1, 2, 4")
@tables
def e8_file_dataset(t):
    edges = code.legacy_edges(t.sources())
    repos = edges.where("edge_type = 'root-repo'").select(F.col("destination").alias("repo"), F.array(F.concat(F.lit("t"), "destination")).alias("tasks"))
    return embedding.file_dataset(edges, repos).select("repo", "file", F.array_join("functions", " ").alias("functions"), "task")


@query()
@tables
def g15_hyperbolic_components(t):
    n = t.nation.select(F.col("n_nationkey").alias("id"))
    pairs = n.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(24))))
    rows = pairs.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", (F.abs(F.col("id") - F.col("j")) / 5.0).alias("d")))), lambda s: s["d"]).alias("distances"))
    got = embedding.hyperbolic_components(rows, 2)
    # a component's sign is free
    return got.select("id", F.round(F.abs(F.col("components")[0]), 4).alias("first"), F.round(F.abs(F.col("components")[1]), 4).alias("second"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS vec_id, list_distance(a.d, b.d) AS distance FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT query, vec_id, round(distance, 5) AS distance FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) <= 5")
@tables
def g16_nearest_nodes(t):
    v = t.embeddings.select("vec_id", F.col("embedding").alias("vector"))
    return embedding.nearest_nodes(v, v.where("vec_id % 50 = 0"), 5, "vec_id").withColumn("distance", F.round("distance", 5))


@query()
@tables
def g16_node_vectors(t):
    """Seeded walks and word2vec; trained, so not in SQL."""
    return embedding.node_vectors(t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target")), size=8).select("word", F.size("vector").alias("size"))

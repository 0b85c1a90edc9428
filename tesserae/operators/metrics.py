"""Corpora with queries and judgements, and the measures of retrieval and generation over them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import sanitize_generated
from tesserae.functions.udf import vectorized
from tesserae.operators import relational as R
from tesserae.operators.retrieval import cosine, terms, top_k
from tesserae.operators.stats import correlation_table

KS = (1, 5, 10, 25)

# corpus


def queries(repos: DataFrame, least: int, column: str = "query_tasks") -> DataFrame:
    """(query_id, query): values with a count of at least `least`, numbered from 0 by falling count."""
    counts = R.frequent_values(repos, column, least, name="query")
    # a row for each distinct task
    return counts.withColumn("query_id", (F.row_number().over(Window.orderBy(F.desc("count"), "query")) - 1).cast("string")).select("query_id", "query")


def judgements(repos: DataFrame, qs: DataFrame, column: str = "tasks") -> DataFrame:
    """(query_id, doc_id, rel): a repo is relevant to a query among its tasks."""
    long = repos.select(F.col("repo").alias("doc_id"), F.explode(column).alias("query")).distinct()
    return long.join(R.few(qs, "queries"), "query").select("query_id", "doc_id", F.lit(1).alias("rel"))


def corpora(repos: DataFrame, columns: dict[str, list[str]], most_tasks: int | None = None) -> DataFrame:
    """(corpus, doc_id, title, text): for each named corpus the repo's texts of its columns, line by line. One pass for all of them."""
    if most_tasks is not None:
        repos = R.with_list_size(repos, "tasks", 0, most_tasks)
    each = F.array(*(F.struct(F.lit(n).alias("corpus"), F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cs)).alias("text")) for n, cs in columns.items()))
    return repos.select(F.col("repo").alias("doc_id"), F.explode(each).alias("e")).select("e.corpus", "doc_id", F.col("doc_id").alias("title"), "e.text")


def documents_in_all(corpus: DataFrame) -> DataFrame:
    """(rows, documents, in_all, same): how many documents there are, how many of them stand in every corpus, and whether all do."""
    n = corpus.agg(F.count_distinct("corpus").alias("n"))
    by_doc = corpus.groupBy("doc_id").agg(F.count_distinct("corpus").alias("c"), F.count("*").alias("r")).join(F.broadcast(n))
    return by_doc.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("rows"), F.count("*").alias("documents"), F.count_if(F.col("c") == F.col("n")).alias("in_all")).withColumn("same", F.col("documents") == F.col("in_all"))


def same_documents(corpus: DataFrame) -> bool:
    """Whether all corpora have the same documents."""
    return documents_in_all(corpus).first().same


# retrieval


def ranked(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(by or []), "query_id").orderBy(F.desc("score"), "doc_id")
    return results.withColumn("rank", F.row_number().over(w))


def per_query(results: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS, by: list[str] | None = None) -> DataFrame:
    """Hits@k, Accuracy@k and Precision@k of each query of the results (and of `by`)."""
    by = by or []
    rows = ranked(results, by).join(qrels.where("rel > 0").select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    out = rows.groupBy(*by, "query_id").agg(*(F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("hit"))), F.lit(0)).cast("double").alias(f"hits_{k}") for k in ks))
    return out.select(*by, "query_id", *(c for k in ks for c in (F.col(f"hits_{k}").alias(f"Hits@{k}"), (F.col(f"hits_{k}") > 0).cast("double").alias(f"Accuracy@{k}"), (F.col(f"hits_{k}") / k).alias(f"Precision@{k}"))))


def hits_at_k(results: DataFrame, qrels: DataFrame, k: int, compat: bool = True) -> DataFrame:
    """Hits by all queries' top k over the number of queries, rounded to five digits. compat: counting begins at one, as the original's does."""
    hits = ranked(results).where(F.col("rank") <= k).join(qrels.where("rel > 0"), ["query_id", "doc_id"], "left_semi").agg(F.count("*").alias("h"))
    n = qrels.agg(F.count_distinct("query_id").alias("n"))
    return hits.join(n).select(F.round((F.col("h") + (1 if compat else 0)) / F.col("n"), 5).alias(f"Hits@{k}"))


def standard(results: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """query_id, recall, r_cap, precision, map, ndcg, mrr at k, and hole, the share of the top k that no query has a judgement of; all queries with judgements."""
    judged = qrels.select("doc_id").distinct().withColumn("_j", F.lit(1))
    relevant = qrels.where("rel > 0").groupBy("query_id").agg(F.count("*").alias("n_rel"), F.reverse(F.array_sort(F.collect_list("rel"))).alias("ideal"))
    top = ranked(results).where(F.col("rank") <= k).join(qrels.select("query_id", "doc_id", "rel"), ["query_id", "doc_id"], "left").join(judged, "doc_id", "left")
    top = top.withColumn("hit", (F.coalesce("rel", F.lit(0)) > 0).cast("int"))
    top = top.withColumn("so_far", F.sum("hit").over(Window.partitionBy("query_id").orderBy("rank")))
    gain = F.coalesce("rel", F.lit(0)) / F.log2(F.col("rank") + 1)
    agg = top.groupBy("query_id").agg(
        F.sum("hit").alias("hits"),
        F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.sum(gain).alias("dcg"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.count_if(F.col("_j").isNull()).alias("holes"),
    )
    best = F.aggregate(F.transform(F.slice("ideal", 1, k), lambda r, i: r / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)
    rows = relevant.withColumn("idcg", best).join(agg, "query_id", "left").na.fill(0, ["hits", "ap", "dcg", "holes"])
    return rows.select(
        "query_id",
        (F.col("hits") / F.col("n_rel")).alias("recall"),
        (F.col("hits") / F.least("n_rel", F.lit(k))).alias("r_cap"),
        (F.col("hits") / k).alias("precision"),
        (F.col("ap") / F.col("n_rel")).alias("map"),
        (F.col("dcg") / F.col("idcg")).alias("ndcg"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.col("holes") / k).alias("hole"),
    )


def with_query_text(scores: DataFrame, qs: DataFrame) -> DataFrame:
    return scores.join(qs, "query_id", "full_outer")


def mean_by(df: DataFrame, by: list[str], metrics: list[str] | None = None) -> DataFrame:
    metrics = metrics or [c for c in R.numeric_columns(df) if c not in by]
    return df.groupBy(*by).agg(*(F.avg(F.col(f"`{m}`")).alias(m) for m in metrics))


def topk_label_accuracy(scores: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Share of all (sample, label) pairs that are among the k highest labels of their sample. scores: sample, label, score; labels: sample, label."""
    w = Window.partitionBy("sample").orderBy(F.desc("score"), "label")
    top = scores.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("sample", "label", F.lit(1).alias("hit"))
    return labels.join(top, ["sample", "label"], "left").agg((F.count("hit") / F.count("*")).alias("accuracy"))


def recalled(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id, num_recalled, recalled, position (of the first hit, from 0, -1 without)."""
    rows = ranked(results).join(qrels.where("rel > 0").select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return rows.groupBy("query_id").agg(F.count("hit").alias("num_recalled"), (F.count("hit") > 0).alias("recalled"), F.coalesce(F.min(F.when(F.col("hit") == 1, F.col("rank"))) - 1, F.lit(-1)).alias("position"))


# generation


def _ngrams(t: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))


def rouge_n(df: DataFrame, key: str, reference: str, generated: str, n: int, target: str) -> DataFrame:
    """df with the F-score of n-grams, repeats counted, of the two texts; 0 where either has none."""

    def grams(c: str, name: str) -> DataFrame:
        t = df.select(key, terms(F.col(c)).alias("_t")).where(F.size("_t") >= n)
        return t.select(key, F.explode(_ngrams(F.col("_t"), n)).alias("g")).groupBy(key, "g").agg(F.count("*").alias(name))

    a, b = grams(reference, "x"), grams(generated, "y")
    both = a.join(b, [key, "g"]).groupBy(key).agg(F.sum(F.least("x", "y")).alias("_both"))
    size = F.greatest(F.size(terms(F.col(reference))) - n + 1, F.lit(0)) + F.greatest(F.size(terms(F.col(generated))) - n + 1, F.lit(0))
    return df.join(both, key, "left").withColumn(target, F.coalesce(2.0 * F.col("_both") / F.nullif(size, F.lit(0)), F.lit(0.0))).drop("_both")


def _numbers(*texts) -> list[np.ndarray]:
    """The words of the texts as numbers."""
    known: dict[str, int] = {}
    return [np.array([known.setdefault(w, len(known)) for w in t], np.int64) for t in texts]


def _common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by one bit a place of a: a row of the table in a few operations on one long number."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    row = every = (1 << len(a)) - 1
    for y in b.tolist():
        met = row & where.get(y, 0)
        row = ((row + met) | (row - met)) & every
    return len(a) - row.bit_count()


def _common(a: np.ndarray, b: np.ndarray) -> set[int]:
    """Places of a in one longest common subsequence of a and b."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, x in enumerate(a):
        # a row is the running maximum of what a match here or the row above gives
        table[i + 1, 1:] = np.maximum.accumulate(np.where(b == x, table[i, :-1] + 1, table[i, 1:]))
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def _f(hits: int, n: int, m: int) -> float:
    return 2 * hits / (n + m) if hits else 0.0


@vectorized("double")
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """F-score of the longest common subsequence of two arrays of words."""
    return pd.Series([_f(_common_length(*_numbers(x, y)), len(x), len(y)) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


@vectorized("double")
def rouge_lsum(a: pd.Series, b: pd.Series) -> pd.Series:
    """F-score of the union, for each line of the reference, of its common subsequences with the other's lines; arrays of arrays of words."""

    def score(x, y) -> float:
        lines = _numbers(*x, *y)
        ours, theirs = lines[: len(x)], lines[len(x) :]
        n = 1 + max((int(a.max()) for a in lines if len(a)), default=-1)
        own, left = (np.bincount(np.concatenate([np.zeros(0, np.int64), *some]), minlength=n) for some in (ours, theirs))
        hits = 0
        for line in ours:
            for i in sorted(set().union(*(_common(line, o) for o in theirs))):
                if own[line[i]] > 0 and left[line[i]] > 0:
                    hits, own[line[i]], left[line[i]] = hits + 1, own[line[i]] - 1, left[line[i]] - 1
        return _f(hits, sum(map(len, ours)), sum(map(len, theirs)))

    return pd.Series([score(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def jaccard(a: Column, b: Column) -> Column:
    """Of two lists as sets; 0 of two empty ones."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


@vectorized("long")
def word_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance of two arrays of words."""

    def distance(x: np.ndarray, y: np.ndarray) -> int:
        steps = np.arange(len(y) + 1)
        row = steps
        for i, p in enumerate(x, 1):
            best = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (y != p))])
            # an insertion costs one for each place to the right
            row = np.minimum.accumulate(best - steps) + steps
        return int(row[-1])

    return pd.Series([distance(*_numbers(x, y)) if x is not None and y is not None else None for x, y in zip(a, b)])


def generation_metrics(df: DataFrame, key: str = "repo", reference: str = "reference", generated: str = "generated", embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """df with rouge1, rouge2, rougeL, rougeLsum, jaccard_lst and edit_word of the generated text; with embed, a function from a text column to a vector column, also similarity, their cosine."""
    if embed is not None:
        df = df.withColumn("similarity", cosine(embed(F.col(reference)), embed(F.col(generated))))
    for n in (1, 2):
        df = rouge_n(df, key, reference, generated, n, f"rouge{n}")
    a, b = terms(F.col(reference)), terms(F.col(generated))

    def lines(c: str) -> Column:
        return F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), terms)

    return df.withColumns({"rougeL": rouge_l(a, b), "rougeLsum": rouge_lsum(lines(reference), lines(generated)), "jaccard_lst": jaccard(a, b), "edit_word": word_edits(a, b)})


def run_evaluation(df: DataFrame, vectors: DataFrame | None = None, key: str = "repo", reference: str = "reference", generated: str = "generated", generation: str = "generation") -> DataFrame:
    """generation_metrics() of each generation's rows, with vectors (word, vector) also bertscore_precision, bertscore_recall and bertscore_f1 from token vectors, the best rougeL first."""
    from tesserae.operators.transport import token_match

    own = F.concat_ws("\0", F.col(key).cast("string"), F.col(generation).cast("string"))
    out = generation_metrics(df.withColumn("_key", own), "_key", reference, generated).drop("_key")
    if vectors is not None:
        out = token_match(out, reference, generated, vectors).withColumnsRenamed({c: f"bertscore_{c}" for c in ("precision", "recall", "f1")})
    return out.orderBy(F.desc("rougeL"), key, generation)


def per_task(metrics: DataFrame, tasks: str = "tasks") -> DataFrame:
    """Means of the numeric columns over the rows of each task."""
    names = R.numeric_columns(metrics)
    return mean_by(metrics.select(F.explode(tasks).alias("task"), *names), ["task"], names)


def long_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value): one row a metric, the form in which experiments and generations are put together."""
    return df.unpivot(keys, metrics, "metric", "value")


def from_generations(df: DataFrame, column: str = "records") -> DataFrame:
    """Rows of a map generation -> list of structs, flat, with the generation."""
    return df.select(F.explode(column).alias("generation", "_r")).select("generation", F.explode("_r").alias("_s")).select("generation", "_s.*")


def postprocess_generations(records: DataFrame) -> DataFrame:
    """repo, tasks, true_tasks, generated_text, prompt_info, generation, input_text of records with prompt_info (struct<name, true_text, …>), generated_text (a list, of which the first counts), input_text, generation."""
    text = F.get("generated_text", F.lit(0))
    return records.select(
        F.col("prompt_info.name").alias("repo"), sanitize_generated(text, F.col("input_text")).alias("tasks"), F.col("prompt_info.true_text").alias("true_tasks"),
        text.alias("generated_text"), "prompt_info", "generation", "input_text",
    )


def per_query_with_generation(generated: DataFrame, ir: DataFrame, task: str = "true_tasks", clipped: str | None = None) -> DataFrame:
    """query and the means of both tables' numeric columns: those of the generated rows that have the query among their tasks, and those of the query's retrieval. clipped: a column whose infinities become its
    largest finite value."""
    rows = R.clip_infinite(generated, clipped) if clipped else generated
    names, scores = R.numeric_columns(generated), [c for c in R.numeric_columns(ir) if c != "query"]
    own = mean_by(rows.select(F.explode(task).alias("query"), *names), ["query"], names)
    return own.join(mean_by(ir, ["query"], scores), "query")


def experiment_grid(search: DataFrame, qrels: DataFrame, queries_: DataFrame, columns: dict[str, list[str]], retrievers: dict, k: int = 100) -> DataFrame:
    """Per-query measures of every column configuration with every retriever, as one long table (columns, retriever, query_id, …). search: doc_id and text columns; a document's text is its columns line by line."""
    found = []
    for name, cs in columns.items():
        docs = search.select("doc_id", F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cs)).alias("text"))
        for retriever, f in retrievers.items():
            found.append(top_k(f(docs, queries_), k).select(F.lit(name).alias("columns"), F.lit(retriever).alias("retriever"), "query_id", "doc_id", "score"))
    return per_query(R.union_all(found), qrels, by=["columns", "retriever"])


def by_generation(evaluated: DataFrame, evaluate: Callable[[DataFrame], DataFrame], generations: list, column: str = "generation") -> DataFrame:
    """evaluate() of each generation's rows, tagged with it, as one table."""
    return R.union_all([evaluate(evaluated.where(F.col(column) == g)).withColumn(column, F.lit(g)) for g in generations])


def report(ir: DataFrame, generated: DataFrame, task: str = "true_tasks", by: str | None = None) -> dict[str, DataFrame]:
    """Tables of an experiment: summaries of either's numeric columns, and rank correlations of retrieval measures with generation measures over queries."""
    measures, made = [c for c in R.numeric_columns(ir) if c != by], [c for c in R.numeric_columns(generated) if c != by]

    def summary(df: DataFrame, names: list[str]) -> DataFrame:
        return R.union_all([R.describe(df, c, [by] if by else None).withColumn("metric", F.lit(c)) for c in names])

    merged = per_query_with_generation(generated, ir, task)
    return {"ir": summary(ir, measures), "generation": summary(generated, made), "correlations": correlation_table(merged, measures, made)}

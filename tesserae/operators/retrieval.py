"""Lexical, dense and hybrid retrieval. Tables: docs (doc_id, text), queries (query_id, query), results (query_id, doc_id, score)."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import tokenize
from tesserae.plans.durable import materialize


def terms(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, tokens: Callable[[Column], Column] = terms, by: list[str] | None = None) -> DataFrame:
    """Scores of all (query, document) that share a term; `by`: columns that tell corpora apart, searched each by itself.

    Texts are split once: the postings of query terms, found by a semi-join before anything is counted, and a row for each document's length are made durable, and all sums come from that table.
    """
    by = by or []
    q = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    base = docs.select(*by, "doc_id", tokens(F.coalesce(F.col("text"), F.lit(""))).alias("_t")).select("*", F.size("_t").alias("dl"))
    # the empty term, which no text has, stands for the document
    wanted = q.select("term").union(docs.sparkSession.range(1).select(F.lit(""))).distinct()
    found = base.select(*by, "doc_id", "dl", F.explode(F.array_append("_t", F.lit(""))).alias("term")).join(wanted, "term", "left_semi")
    found = materialize(found.groupBy(*by, "doc_id", "dl", "term").agg(F.count("*").alias("tf")), "postings")
    totals = found.where("term = ''").groupBy(*by).agg(F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    tf = found.where("term <> ''")
    df = tf.groupBy(*by, "term").agg(F.count("*").alias("df"))
    stats = df.join(totals, by) if by else df.join(F.broadcast(totals))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    post = tf.join(stats.select(*by, "term", "n", "df", "avgdl"), [*by, "term"]).select(*by, "term", "doc_id", weight.alias("w"))
    return _sums_by_document(post, q, F.col("w") * F.col("qf"), by)


#: Rows (query_id, term, weight) of queries that are sent to every task at most.
FEW_ROWS = 1 << 20


def _sums_by_document(docs: DataFrame, queries: DataFrame, product: Column, by: list[str]) -> DataFrame:
    """(by, query_id, doc_id, score): sums of the product over the terms that a document and a query share.

    Where queries are few enough to be sent, documents are dealt by doc_id, and their products are summed up where they are made: postings are shuffled, not a row for each pair and task. More queries are joined by term.
    """
    if queries.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        terms_of = F.broadcast(queries.select("term").distinct())
        docs = docs.join(terms_of, "term", "left_semi").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
        queries = F.broadcast(queries)
    return docs.join(queries, "term").groupBy(*by, "query_id", "doc_id").agg(F.sum(product).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(c: Column) -> Column:
    norm = F.sqrt(dot(c, c))
    return F.transform(c, lambda x: x.cast("double") / norm)


#: Bytes of query vectors that are sent to every task at once.
QUERY_BYTES = 1 << 26
#: Scores that a task makes at a time, at most, unless a block has more queries.
CELLS = 1 << 20


def _flat(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _products(normalise: bool):
    """Scores of single vectors."""

    def unit(column: pa.Array) -> np.ndarray:
        rows = _flat(column)
        return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True)) if normalise else rows

    def prepare(queries: pa.Array):
        q = unit(queries)
        return lambda column: q @ unit(column).T

    return prepare


def _best_products(queries: pa.Array):
    """Scores of lists of vectors: for each of the query's its highest product with one of the document's, summed."""
    q, starts = _flat(queries.flatten()), np.cumsum([0, *(len(x) for x in queries)])[:-1]

    def scores(column: pa.Array) -> np.ndarray:
        at = np.cumsum([0, *(len(x) for x in column)])[:-1]
        return np.add.reduceat(np.maximum.reduceat(q @ _flat(column.flatten()).T, at, axis=1), starts, axis=0)

    return scores


def _search(docs: DataFrame, queries: pa.Table, k: int, prepare, chunk: int = 1024) -> DataFrame:
    """Of each task's documents (doc_id, vectors) the k highest of each query (query_id, vectors), scored in chunks: no more rows leave the task. prepare: query vectors -> (document vectors -> scores by query and document)."""
    from pyspark.sql.pandas.types import from_arrow_schema

    kinds = {"query_id": queries.schema.field("query_id").type, "doc_id": docs.select("doc_id").limit(0).toArrow().schema.field("doc_id").type}
    schema = pa.schema([*kinds.items(), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.combine_chunks()
        if not table.num_rows:
            return
        # what a product takes doesn't grow with the queries
        size_of = max(1, min(chunk, CELLS // table.num_rows))
        ids, score = table.column(0).chunk(0), prepare(table.column(1).chunk(0))
        least, held, size = np.full(len(ids), -np.inf), [], 0

        def best() -> pa.Table:
            rows = pa.concat_tables(held)
            rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("score", "descending"), ("doc_id", "ascending")]))
            of = rows.column("q").to_numpy()
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            full = rank == k - 1
            least[of[full]] = rows.column("score").to_numpy()[full]
            return rows.filter(pa.array(rank < k))

        for batch in batches:
            for lo in range(0, batch.num_rows, size_of):
                part = batch.slice(lo, size_of)
                scores = score(part.column(1))
                i, j = np.nonzero(scores >= least[:, None])
                held.append(pa.table({"q": i, "doc_id": part.column(0).take(pa.array(j)), "score": scores[i, j]}))
                size += len(i)
                if size > 4 * k * len(ids) + (1 << 16):
                    held = [best()]
                    size = held[0].num_rows
        if held:
            rows = best()
            yield from pa.table([ids.take(rows.column("q").combine_chunks()), rows.column("doc_id"), rows.column("score")], schema=schema).to_batches(max_chunksize=10_000)

    return docs.mapInArrow(run, from_arrow_schema(schema))


def _blocks(queries: DataFrame, size: Column, most_bytes: int) -> Iterator[pa.Table]:
    """The stated query set in blocks of at most about so many bytes, of which the driver holds one at a time; for all rows against all see nearest.py."""
    total = queries.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = max(1, -(-total // most_bytes))
    for b in range(n):
        yield (queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) if n > 1 else queries).toArrow()


def dense(docs: DataFrame, queries: DataFrame, k: int, normalise: bool = True, most_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k highest of each query by cosine (or dot) product of `embedding`, exactly; ties by doc_id. Rows without a vector are left out.

    All documents are scored against a stated query set, in blocks of at most about most_bytes of query vectors, each of which every task gets and one scan answers.
    """
    vector = F.col("embedding")
    queries, docs = (df.select(key, "embedding").where(vector.isNotNull()) for df, key in ((queries, "query_id"), (docs, "doc_id")))
    parts = [_search(docs, q, k, _products(normalise)) for q in _blocks(queries, F.size(vector).cast("long") * 8, most_bytes)]
    return top_k(functools.reduce(DataFrame.unionAll, parts), k)


def late_interaction(docs: DataFrame, queries: DataFrame, k: int, most_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k highest of each query by token vectors, `vectors` on both sides: for each of the query's the highest dot product with one of the document's, summed. Rows without vectors are left out."""
    vectors = F.col("vectors")
    queries, docs = (df.select(key, "vectors").where(F.size(vectors) > 0) for df, key in ((queries, "query_id"), (docs, "doc_id")))
    parts = [_search(docs, q, k, _best_products, chunk=64) for q in _blocks(queries, F.size(vectors).cast("long") * F.size(vectors[0]) * 8, most_bytes)]
    return top_k(functools.reduce(DataFrame.unionAll, parts), k)


def similarity_top(results: DataFrame, k: int, side: str = "row") -> DataFrame:
    """The k highest scores of each row (query) or column (document) of a similarity table."""
    by, other = ("query_id", "doc_id") if side == "row" else ("doc_id", "query_id")
    w = Window.partitionBy(by).orderBy(F.desc("score"), other)
    return results.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def top_k(results: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k highest of each query, ties by doc_id."""
    w = Window.partitionBy(*(by or []), "query_id").orderBy(F.desc("score"), "doc_id")
    return results.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def sparse_dot(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores of learnt sparse vectors, rows (id, term, weight) on both sides."""
    return _sums_by_document(docs.withColumnRenamed("weight", "_w"), queries, F.col("weight") * F.col("_w"), [])


def hybrid(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two result tables merged per query by taking the best left of each in turn, scores as shares of their sum, until there are as many documents as in the longer.

    A document in both keeps its first place and takes the later score. position: from 1. Turns: `first` is asked before `second`; the merge
    may end one over, as the check stands after both. Ties go to the larger doc_id.
    """

    def ranked(df: DataFrame, which: int) -> DataFrame:
        w = Window.partitionBy("query_id")
        order = w.orderBy(F.desc("score"), F.desc("doc_id"))
        return df.select("query_id", "doc_id", (F.col("score") / F.sum("score").over(w)).alias("score"), (2 * F.row_number().over(order) + which).alias("turn"), F.count("*").over(w).alias("n"))

    turns = ranked(first, 0).unionAll(ranked(second, 1))
    q = Window.partitionBy("query_id")
    rows = turns.withColumn("longest", F.max("n").over(q)).withColumn("first_turn", F.min("turn").over(Window.partitionBy("query_id", "doc_id")))
    # how many different documents there are after a pass, which is a pair of turns
    seen = F.sum((F.col("turn") == F.col("first_turn")).cast("int")).over(q.orderBy(F.floor(F.col("turn") / 2)).rangeBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(seen, F.lit(0))).where(F.col("before") < F.col("longest"))
    merged = rows.groupBy("query_id", "doc_id").agg(F.min("turn").alias("turn"), F.max_by("score", "turn").alias("score"))
    return merged.select("query_id", "doc_id", "score", F.row_number().over(q.orderBy("turn")).alias("position"))


#: Terms of most of a block's queries, of which products are dense; documents scored at once.
DENSE_TERMS, DOCS_AT_ONCE = 256, 256


def _cosines(kinds: pa.Schema):
    """Rows (grp, query_id, doc_id, score) of each document (grp, doc_id, terms, x), in unit length, and the block's queries of its group (grp, query_id, terms, y) that share a term with it."""

    def postings(part: pa.Table):
        """Of a group's queries: terms with their places, dense weights of the first ones, and the others' by term."""
        lists = part.column(2).combine_chunks()
        coded = lists.flatten().dictionary_encode()
        row, term, y = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), coded.indices.to_numpy(), part.column(3).combine_chunks().flatten().to_numpy()
        n = np.bincount(term, minlength=len(coded.dictionary))
        place = np.empty(len(n), np.int64)
        place[np.argsort(-n, kind="stable")] = np.arange(len(n))
        term = place[term]
        first = min(DENSE_TERMS, len(n))
        dense = np.zeros((first, len(lists)))
        dense[term[term < first], row[term < first]] = y[term < first]
        order = np.argsort(term, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(n)))])
        return part.column(1).combine_chunks(), coded.dictionary, place, dense, starts, row[order], y[order]

    def score(part: pa.RecordBatch, held) -> pa.RecordBatch:
        ids, words, place, dense, starts, rows, ys = held
        lists = part.column(2)
        found = pc.index_in(lists.flatten(), value_set=words)
        keep = found.is_valid().to_numpy(zero_copy_only=False)
        term, x = place[found.drop_null().to_numpy()], part.column(3).flatten().to_numpy()[keep]
        doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())[keep]
        less = term >= len(dense)
        common = np.zeros((len(lists), len(dense)))
        common[doc[~less], term[~less]] = x[~less]
        size = starts[term[less] + 1] - starts[term[less]]
        at = np.repeat(starts[term[less]] - np.cumsum(size) + size, size) + np.arange(size.sum())
        rare = np.bincount(np.repeat(doc[less], size) * len(ids) + rows[at], weights=np.repeat(x[less], size) * ys[at], minlength=len(lists) * len(ids))
        scores = common @ dense + rare.reshape(len(lists), -1)
        # all weights are above 0
        i, j = np.nonzero(scores)
        i, j, s = pa.array(i), pa.array(j), pa.array(scores[i, j])
        return pa.record_batch([part.column(0).take(i), ids.take(j), part.column(1).take(i), s], schema=kinds)

    return postings, score


def _weighted(batch: pa.RecordBatch, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Documents (grp, doc_id, n, hashes of words) as vectors of unit length (grp, doc_id, terms, x), by group. held: hashes in ascending order and the number of documents that have them, of terms in two documents or more."""
    batch = batch.take(pc.sort_indices(batch.column(0)))
    lists = batch.column(3)
    doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy()
    having = np.ones(len(words))
    for hashes, df in (h for h in held if len(h[0])):
        at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
        having = np.where(hashes[at] == words, df[at], having)
    pair, tf = np.unique(doc * len(words) + coded.indices.to_numpy(), return_counts=True)
    doc, word = np.divmod(pair, len(words))
    x = tf * (np.log((1 + batch.column(2).to_numpy()[doc]) / (1 + having[word])) + 1)
    x /= np.sqrt(np.bincount(doc, weights=x * x, minlength=len(lists)))[doc]
    starts = pa.array(np.searchsorted(doc, np.arange(len(lists) + 1)), pa.int32())
    return pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(starts, pa.array(words[word])), pa.ListArray.from_arrays(starts, pa.array(x))], names=["grp", "doc_id", "terms", "x"])


def tfidf_cosine(docs: DataFrame, queries: DataFrame, tokens: Callable[[Column], Column] = tokenize, most_bytes: int = QUERY_BYTES) -> DataFrame:
    """Cosine of tf-idf vectors of every query and the documents of its group that share a term with it; docs (grp, doc_id, text), queries (grp, query_id, query).

    Only texts and counts by term are shuffled. Terms go by hashes that no two of them share; numbers of documents of terms in two or more, and blocks of about most_bytes of queries, are sent, and each document is weighted and scored where it lies:
    no posting, product or pair is shuffled or kept. The result stays the product of a group's queries and documents.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = tokens(F.lower(F.col("text")))
    d = materialize(docs.select("grp", "doc_id", "text").where(F.col("grp").isNotNull()).repartition(parts, "grp", "doc_id"), "texts")
    n = materialize(d.groupBy("grp").agg(F.count("*").alias("n")), "documents")
    d = d.select("grp", "doc_id", words.alias("words"))
    if not d.groupBy("grp", "doc_id").count().where("count > 1").isEmpty():
        # rows of one id are one document
        d = materialize(d.groupBy("grp", "doc_id").agg(F.flatten(F.collect_list("words")).alias("words")), "texts")
    df = materialize(d.select("grp", F.explode(F.array_distinct("words")).alias("term")).groupBy("grp", "term").agg(F.count("*").alias("df")), "terms")

    def code(seed: int, term) -> Column:
        return F.xxhash64("grp", term, F.lit(seed))

    seed = next(i for i in itertools.count() if df.groupBy(code(i, "term").alias("h")).count().where("count > 1").isEmpty())
    common = df.where("df > 1").select(code(seed, "term").alias("h"), "df")
    blocks = -(-common.count() * 16 // most_bytes)

    def sent(b: int):
        rows = common.where(F.pmod("h", F.lit(blocks)) == b).toArrow().sort_by("h")
        return spark.sparkContext.broadcast((rows.column("h").to_numpy(), rows.column("df").to_numpy()))

    counts = [sent(b) for b in range(blocks)]

    tf = queries.select("grp", "query_id", F.explode(tokens(F.lower(F.col("query")))).alias("term")).groupBy("grp", "query_id", "term").agg(F.count("*").alias("tf"))
    weight = F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    weighted = tf.join(df, ["grp", "term"]).join(F.broadcast(n), "grp").select("grp", "query_id", code(seed, "term").alias("h"), weight.alias("y"))
    lists = weighted.groupBy("grp", "query_id").agg(F.collect_list("h").alias("terms"), F.collect_list("y").alias("y"), F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
    y = materialize(lists.select("grp", "query_id", "terms", F.transform("y", lambda v: v / F.col("norm")).alias("y")), "unit-vectors")

    hashed = F.transform("words", lambda t: code(seed, t)).alias("h")
    x = d.where(F.col("doc_id").isNotNull() & (F.size("words") > 0)).join(F.broadcast(n), "grp").select("grp", "doc_id", "n", hashed)
    schema = x.select("grp").schema.add(y.schema["query_id"]).add(x.schema["doc_id"]).add("score", "double")
    kinds = to_arrow_schema(schema)

    def block(q: pa.Table) -> DataFrame:
        shared = spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            postings, score = _cosines(kinds)
            held = [c.value for c in counts]
            by_group = {g: i for i, g in enumerate(shared.value.column(0).unique().to_pylist())}
            place = pc.index_in(shared.value.column(0), value_set=pa.array(by_group, shared.value.schema.field(0).type))
            order = pc.sort_indices(place)
            rows, ends = shared.value.take(order), np.cumsum([0, *np.bincount(place.to_numpy(), minlength=len(by_group))])
            for batch in batches:
                # documents of groups that have queries
                batch = batch.filter(pc.is_in(batch.column(0), value_set=pa.array(by_group, batch.schema.field(0).type)))
                if not batch.num_rows:
                    continue
                batch = _weighted(batch, held)
                groups = batch.column(0).to_numpy(zero_copy_only=False)
                bounds = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
                for lo, hi in zip(bounds, bounds[1:]):
                    g = by_group[batch.column(0)[lo].as_py()]
                    own = postings(rows.slice(ends[g], ends[g + 1] - ends[g]))
                    for at in range(lo, hi, DOCS_AT_ONCE):
                        yield score(batch.slice(at, min(DOCS_AT_ONCE, hi - at)), own)

        return x.mapInArrow(run, schema)

    return functools.reduce(DataFrame.unionAll, [block(q) for q in _blocks(y, F.size("terms").cast("long") * 16, most_bytes)])


def recall_at(results: DataFrame, wanted: DataFrame, k: int = 100) -> DataFrame:
    """The share of queries (query_id, doc_id in `wanted`) whose document is among their k highest."""
    hits = wanted.join(top_k(results, k).select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hits.agg(F.count("*").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


#: Elements of a vector that mean_vector sums up in one row.
PIECE = 8


def mean_vector(df: DataFrame, by: list[str], column: str = "embedding") -> DataFrame:
    """The mean of a group's vectors, element by element. Vectors are cut into pieces, whose elements are averaged side by side: a task has a row for each group and piece, not for each element."""
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"(size(`{column}`) - 1) div {PIECE}").cast("int")), lambda i: F.slice(column, i * PIECE + 1, PIECE))
    pieces = df.where(F.col(column).isNotNull()).select(*by, F.posexplode(cut).alias("pos", "_x")).where(F.size("_x") > 0)
    means = pieces.groupBy(*by, "pos").agg(F.max(F.size("_x")).alias("_n"), *(F.avg(F.get("_x", F.lit(i)).cast("double")).alias(f"_{i}") for i in range(PIECE)))
    row = F.struct("pos", F.slice(F.array(*(f"_{i}" for i in range(PIECE))), F.lit(1), F.col("_n")).alias("x"))
    return means.groupBy(*by).agg(F.flatten(F.transform(F.array_sort(F.collect_list(row)), lambda s: s["x"])).alias(column))


def nearest_to_mean(df: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """The k rows of each group nearest to its mean vector: (by, key, score)."""
    centre = mean_vector(df, [by]).withColumnRenamed("embedding", "_m")
    scored = df.join(centre, by).select(by, key, cosine(F.col("embedding"), F.col("_m")).alias("score"))
    w = Window.partitionBy(by).orderBy(F.desc("score"), key)
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def analogy(docs: DataFrame, positive: list, negative: list, k: int) -> DataFrame:
    """The k documents most like the sum of the positive ids' unit vectors less the negative ones', without these."""
    signs = docs.where(F.col("doc_id").isin([*positive, *negative]))
    signed = F.when(F.col("doc_id").isin(negative), F.lit(-1.0)).otherwise(F.lit(1.0)) if negative else F.lit(1.0)
    u = unit(F.col("embedding"))
    q = mean_vector(signs.select(F.lit(0).alias("query_id"), F.transform(u, lambda x: x * signed).alias("embedding")), ["query_id"])
    return dense(docs.where(~F.col("doc_id").isin([*positive, *negative])), q, k)

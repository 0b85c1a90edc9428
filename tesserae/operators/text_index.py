"""A stored text index: written once, then counted and searched by BM25 without reading the texts or the postings of other terms.

Documents, in an order that puts like ones together, are cut into runs. A posting row holds one term's documents of one run, with counts and lengths, in a directory by a hash of the term. A second, small table bounds for each
term and run what the term can add to a document's score. A search reads only the directories of its terms; sums of bounds tell which runs can hold one of the k highest at all, and only these are read and scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.operators.retrieval import FEW_ROWS, terms
from tesserae.plans.durable import materialize, steps

K1, B = 1.2, 0.75
#: Pairs of a query and a document that a task of a search sums up, at most about.
PAIRS = 1 << 21


def _saturated(tf: Column, dl: Column, mean: Column | float, k1: float, b: float) -> Column:
    mean = F.lit(mean) if isinstance(mean, float) else mean
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))


class TextIndex:
    """An index that write() has made, with its statistics (number of documents, their mean length, settings) read."""

    def __init__(self, spark: SparkSession, path: str, tokens: Callable[[Column], Column] = terms):
        self.spark, self.path, self.tokens = spark, path, tokens
        meta = spark.read.parquet(f"{path}/meta").first()
        self.n, self.mean_length, self.buckets, self.k1, self.b = meta.n, meta.mean_length, meta.buckets, meta.k1, meta.b
        self._kinds = {"postings": f"term string, run long, docs array<{meta.key}>, tfs array<int>, dls array<int>, bucket int", "bounds": "term string, run long, df long, best double, bucket int"}

    def count(self) -> int:
        """How many documents it holds."""
        return self.n

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _table(self, name: str, buckets: list[int]) -> DataFrame:
        """Rows of these directories only."""
        return self.spark.read.schema(self._kinds[name]).parquet(f"{self.path}/{name}").where(F.col("bucket").isin(buckets))

    def _asked(self, wanted: DataFrame) -> list[int]:
        """Directories of the terms, of which there are few by construction."""
        return [r.bucket for r in wanted.select("bucket").distinct().collect()]

    def frequencies(self, words: DataFrame) -> DataFrame:
        """(term, df): in how many documents each term of `words` stands; terms without one are left out."""
        wanted = words.select("term").distinct().select("term", self._bucket())
        return self._table("bounds", self._asked(wanted)).join(wanted, ["bucket", "term"], "left_semi").groupBy("term").agg(F.sum("df").alias("df"))

    def _found(self, name: str, weights: DataFrame, buckets: list[int], pairs: int) -> DataFrame:
        """Rows of the query terms, dealt by run in so many parts that about PAIRS of `pairs` fall on each."""
        wanted = weights.select("bucket", "term").distinct()
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))
        return self._table(name, buckets).join(F.broadcast(wanted) if weights.count() <= FEW_ROWS else wanted, ["bucket", "term"], "left_semi").repartition(parts, "run")

    def _scores(self, weights: DataFrame, runs: DataFrame, buckets: list[int], queries: int) -> DataFrame:
        """Scores of all documents of the runs (query_id, run). Postings are dealt by run, and sums are made where they lie."""
        asked = runs.groupBy("run").agg(F.collect_set("query_id").alias("asked"))
        found = self._found("postings", weights, buckets, self.n * queries).join(asked, "run").join(weights, ["bucket", "term"]).where(F.array_contains("asked", F.col("query_id")))
        rows = found.select("query_id", "run", "weight", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p"))
        add = F.col("weight") * _saturated(F.col("p.tfs"), F.col("p.dls"), self.mean_length, self.k1, self.b)
        return rows.groupBy("query_id", "run", F.col("p.docs").alias("doc_id")).agg(F.sum(add).alias("score")).select("query_id", "doc_id", "score")

    def _bounded(self, queries: DataFrame, step) -> tuple[DataFrame, DataFrame, list[int], int]:
        """(query_id, bucket, term, weight), by query and run the highest score that a document can have, the directories of the terms, and the number of queries."""
        q = queries.select("query_id", F.explode(self.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf")).select("query_id", "term", "qf", self._bucket())
        q = step(q, "query-terms")
        buckets, n = self._asked(q), q.select("query_id").distinct().count()
        df = self._table("bounds", buckets).groupBy("bucket", "term").agg(F.sum("df").alias("df"))
        idf = F.log(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = step(q.join(df, ["bucket", "term"]).select("query_id", "bucket", "term", (idf * F.col("qf")).alias("weight")), "weights")
        weights = F.broadcast(weights) if weights.count() <= FEW_ROWS else weights
        found = self._found("bounds", weights, buckets, 0).join(weights, ["bucket", "term"])
        return weights, found.groupBy("query_id", "run").agg(F.sum(F.col("weight") * F.col("best")).alias("most")), buckets, n

    def search(self, queries: DataFrame, k: int, probe: int = 4, digits: int = 9, work: bool = False) -> DataFrame:
        """(query_id, doc_id, score): the k highest of each query (query_id, query), exactly those of bm25(); scores that agree to `digits` tie and go by doc_id.

        The `probe` runs of the highest bounds are scored first; their k-th score is a threshold, and of the other runs those with a bound below it are never read. work=True gives (query_id, runs, read) instead: how
        many runs hold a term of the query, and how many were scored. Null queries and such without a known term have no rows.
        """
        with steps(self.spark) as step:
            weights, most, buckets, n = self._bounded(queries, step)
            most = step(most, "run-bounds")
            by_query = Window.partitionBy("query_id").orderBy(F.desc("most"), "run")
            first = most.withColumn("_r", F.row_number().over(by_query)).where(F.col("_r") <= probe).select("query_id", "run")
            ranked = self._scores(weights, first, buckets, n).withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
            least = ranked.where(F.col("_r") == k).select("query_id", F.col("score").alias("least"))
            kept = most.join(least, "query_id", "left").where(F.coalesce(F.col("least"), F.lit(0.0)) * (1 - 1e-9) <= F.col("most")).select("query_id", "run")
            if work:
                out = most.groupBy("query_id").agg(F.count("*").alias("runs")).join(kept.groupBy("query_id").agg(F.count("*").alias("read")), "query_id")
            else:
                order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), "doc_id")
                out = self._scores(weights, kept, buckets, n).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
            return materialize(out, "search")


def _postings(run: int):
    """Of documents (doc_id, terms) in order, the postings of each run of so many: of every term its documents, how often they have it, and their lengths. The null term has all documents of the run."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 33, []

        def postings(docs: pa.Table) -> pa.RecordBatch:
            docs = docs.combine_chunks()
            ids, lists = docs.column(0).chunk(0), docs.column(1).chunk(0)
            sizes = np.diff(lists.offsets.to_numpy())
            coded = lists.flatten().dictionary_encode()
            at, n = np.repeat(np.arange(len(ids)), sizes), len(ids)
            pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + at, return_counts=True)
            # the null term comes last
            of = np.concatenate([pairs % n, np.arange(n)])
            term, first = np.unique(np.concatenate([pairs // n, np.full(n, len(coded.dictionary))]), return_index=True)
            offsets = pa.array(np.append(first, len(of)), pa.int32())
            values = (ids.take(pa.array(of)), pa.array(np.concatenate([tf, np.zeros(n, np.int64)]), pa.int32()), pa.array(sizes[of], pa.int32()))
            names = pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)]).take(pa.array(term))
            return pa.record_batch([names, pa.array(np.full(len(term), number)), *(pa.ListArray.from_arrays(offsets, v) for v in values)], ["term", "run", "docs", "tfs", "dls"])

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                part = batch.slice(lo, run - sum(b.num_rows for b in held))
                held.append(part)
                lo += part.num_rows
                if sum(b.num_rows for b in held) == run:
                    yield postings(pa.Table.from_batches(held))
                    number, held = number + 1, []
        if held:
            yield postings(pa.Table.from_batches(held))

    return go


def write(docs: DataFrame, path: str, order: list[str] | None = None, run: int = 1024, buckets: int = 64, k1: float = K1, b: float = B, tokens: Callable[[Column], Column] = terms) -> TextIndex:
    """Index docs (doc_id, text); doc_id is a key. order: columns that put like documents together, before doc_id, which makes bounds of runs tighter; run, a power of two: documents of a run at most; buckets: directories.

    Null texts are empty; documents without a term count for the mean length. Whatever was at the path is replaced.
    """
    if run < 1 or run & (run - 1):
        raise ValueError("run must be a power of two")
    spark, order = docs.sparkSession, [*(order or []), "doc_id"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.select(*dict.fromkeys(order), "text").repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("_t"))
    rows = held.mapInArrow(_postings(run), f"term string, run long, docs array<{kind}>, tfs array<int>, dls array<int>")
    rows = rows.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "run").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
    written = spark.read.schema(rows.schema).parquet(f"{path}/postings")
    stats = written.where("bucket = -1").select(F.explode("dls").alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("mean_length")).first()
    mean = float(stats.mean_length) or 1.0
    best = F.array_max(F.zip_with("tfs", "dls", lambda tf, dl: _saturated(tf, dl, mean, k1, b)))
    bounds = written.where("bucket >= 0").select("term", "run", F.size("docs").cast("long").alias("df"), best.alias("best"), "bucket")
    bounds.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "run").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/bounds")
    meta = "n long, mean_length double, buckets int, k1 double, b double, key string"
    spark.createDataFrame([(stats.n, mean, buckets, float(k1), float(b), kind)], meta).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return TextIndex(spark, path, tokens)

"""Vectors of words that a model has never seen, from their parts, and vectors of whole texts, from a fixed matrix of word vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import tokenize
from tesserae.operators.retrieval import _flat
from tesserae.plans.durable import Steps, materialize

BUCKETS = 1 << 20


def parts_of(word: Column, least: int = 3, most: int = 6) -> Column:
    """The character n-grams of a word between < and >, each once."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))

    def grams(n: int) -> Column:
        return F.when(F.length(marked) >= n, F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.substring(marked, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*(grams(n) for n in range(least, most + 1))))


def _parts(words: DataFrame, buckets: int, least: int, most: int) -> DataFrame:
    """(word, bucket, share): the buckets of a word's n-grams, by their MD5, each with its share of the word."""
    rows = words.select("word", F.explode(parts_of(F.col("word"), least, most)).alias("g"))
    bucket = (F.conv(F.substring(F.md5("g"), 1, 8), 16, 10).cast("long") % buckets).alias("bucket")
    counted = rows.select("word", bucket).groupBy("word", "bucket").agg(F.count("*").alias("n"))
    return counted.select("word", "bucket", (F.col("n") / F.sum("n").over(Window.partitionBy("word"))).alias("share"))


def _sums(rows: DataFrame, by: str, weight: Column, vector: str, width: int) -> DataFrame:
    return rows.groupBy(by).agg(F.array(*(F.sum(weight * F.col(vector)[i]) for i in range(width))).alias("x"), F.sum(weight).alias("total"))


def subword_vectors(words: DataFrame, width: int, steps: int = 10, buckets: int = BUCKETS, least: int = 3, most: int = 6) -> DataFrame:
    """(bucket, vector): vectors of hashed character n-grams whose mean over a word's n-grams is as near to the word's own vector as `steps` steps get, from zeros.

    words: word, vector (of this width). A step spreads each word's error over its n-grams, as much as each has of the word, and divides by what the bucket has of all words; that never diverges. Words and n-grams meet by joins, so
    neither table is held whole anywhere. Words with a null vector are left out; so are words too short for an n-gram.
    """
    spark = words.sparkSession
    step = Steps(spark)
    known = step(words.where("word is not null and vector is not null").select("word", F.col("vector").cast("array<double>").alias("v")).dropDuplicates(["word"]), "words")
    parts = step(_parts(known, buckets, least, most), "parts")
    zero = F.array(*(F.lit(0.0) for _ in range(width)))
    table = step(parts.select("bucket").distinct().select("bucket", zero.alias("b")), "buckets")
    for _ in range(steps):
        made = _sums(parts.join(table, "bucket"), "word", F.col("share"), "b", width)
        error = known.join(made, "word").select("word", F.zip_with("v", "x", lambda v, x: v - x).alias("e"))
        moved = _sums(parts.join(error, "word"), "bucket", F.col("share"), "e", width)
        last, table = table, step(table.join(moved, "bucket").select("bucket", F.zip_with("b", F.transform("x", lambda x: x / F.col("total")), lambda b, x: b + x).alias("b")), "buckets")
        step.drop(last)
    out = materialize(table.select("bucket", F.col("b").alias("vector")), "subwords")
    step.drop()
    return out


def compose(words: DataFrame, table: DataFrame, width: int, buckets: int = BUCKETS, least: int = 3, most: int = 6) -> DataFrame:
    """(word, vector) of any words, seen in training or not: the mean vector of their n-grams, of which unknown ones count as zeros. Words without an n-gram, or with unknown ones only, have zeros."""
    some = words.where("word is not null").select("word").distinct()
    made = _sums(_parts(some, buckets, least, most).join(table.withColumnRenamed("vector", "b"), "bucket"), "word", F.col("share"), "b", width)
    return some.join(made, "word", "left").select("word", F.coalesce("x", F.array(*(F.lit(0.0) for _ in range(width)))).alias("vector"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def loss(v: np.ndarray, n: np.ndarray, words: np.ndarray, others: np.ndarray, negatives: float) -> tuple[float, np.ndarray]:
    """Of a text's vector v how badly it tells the text's words, n times each, from other ones, a token's mean, and the gradient. Against each token stand `negatives` of the others, in equal parts."""
    weight = negatives / len(others) if len(others) else 0.0
    p, q = sigmoid(words @ v), sigmoid(others @ v)
    value = -(n * np.log(np.maximum(p, 1e-300))).sum() / n.sum() - weight * np.log(np.maximum(1 - q, 1e-300)).sum()
    return float(value), -(n * (1 - p)) @ words / n.sum() + weight * (q @ others)


def common_words(words: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most so many words (word, vector, and n if there is a column of it), by a seeded MD5, frequent ones likelier: the others that texts are told from."""
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "word")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    chance = digest / F.pow(F.col("n").cast("double"), F.lit(0.75)) if "n" in words.columns else digest
    return words.where("vector is not null").orderBy(chance, "word").limit(most)


def paragraph_vectors(docs: DataFrame, words: DataFrame, others: DataFrame, steps: int = 20, rate: float = 1.0, negatives: float = 5.0, tokens: Callable[[Column], Column] = tokenize) -> DataFrame:
    """(doc_id, vector): each text's vector, found by `steps` gradient steps from zeros with the word vectors held fixed, as for a text that comes after training. Texts don't touch each other, so a batch is a task's own.

    docs: doc_id (a key), text; words: word, vector; others: words that are told from a text's own, bounded by most of common_words(), which every task gets. The problem is convex, so the result depends on nothing but the text and
    the matrix. Words without a vector are left out; texts without a known word have no row.
    """
    spark = docs.sparkSession
    far = _flat(others.orderBy("word").select(F.col("vector").cast("array<double>").alias("v")).toArrow().column(0).combine_chunks())
    sent = spark.sparkContext.broadcast(far)
    counted = docs.select("doc_id", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    bags = counted.join(words.where("vector is not null").select("word", F.col("vector").cast("array<double>").alias("v")), "word").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word", "n", "v"))).alias("bag"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                n = np.array(batch.column(1)[i].as_py(), float)
                own = _flat(batch.column(2)[i].values)
                v = np.zeros(own.shape[1])
                for _ in range(steps):
                    v = v - rate * loss(v, n, own, sent.value.reshape(-1, own.shape[1]), negatives)[1]
                out.append(v.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "vector"])

    return bags.select("doc_id", "bag.n", "bag.v").mapInArrow(fit, f"doc_id {kind}, vector array<double>")

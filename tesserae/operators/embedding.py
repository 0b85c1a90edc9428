"""Embeddings and clusters by MLlib."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import tokenize
from tesserae.operators import ranks
from tesserae.operators.retrieval import dot
from tesserae.plans.durable import steps

#: Words that a task trains a word2vec model on, about.
TASK_WORDS = 1 << 22


def train_word2vec(df: DataFrame, text: str, size: int = 200, window: int = 5, least: int = 5, longest: int = 1000, seed: int = 0, tokens=tokenize):
    """A word2vec model of the texts' words, sentences cut at `longest`. It is trained on TASK_WORDS words a task, about, whose models are averaged; fewer are one task's."""
    with steps(df.sparkSession) as step:
        rows = step(df.select(tokens(F.col(text)).alias("_w")), "sentences")
        words = rows.agg(F.sum(F.size("_w"))).first()[0] or 0
        trainer = Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxSentenceLength=longest, seed=seed, inputCol="_w", outputCol="embedding", numPartitions=max(1, -(-words // TASK_WORDS)))
        return trainer.fit(rows)


def embed(model, df: DataFrame, text: str, tokens=tokenize) -> DataFrame:
    """df with embedding: the mean vector of a text's words."""
    return model.transform(df.withColumn("_w", tokens(F.col(text)))).drop("_w").withColumn("embedding", vector_to_array("embedding"))


def vectors(model) -> DataFrame:
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def _vector(df: DataFrame) -> DataFrame:
    return df.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))


def clusters(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """df with cluster."""
    df = _vector(df)
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(df).transform(df).drop("_v")


def central_rows(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The n rows of each group nearest to its centre, by Euclidean distance."""
    from tesserae.operators.retrieval import mean_vector

    centre = mean_vector(df, [by]).withColumnRenamed("embedding", "_m")
    gap = F.aggregate(F.zip_with("embedding", "_m", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    w = Window.partitionBy(by).orderBy("distance", key)
    scored = df.join(centre, by).select(by, key, F.sqrt(gap).alias("distance"))
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def _times(share: Column):
    return lambda y: share * y


def without_components(df: DataFrame, n: int) -> DataFrame:
    """embedding less its part along the n first principal components of all rows."""
    df = _vector(df)
    pc = PCA(k=n, inputCol="_v", outputCol="_p").fit(df).pc.toArray().T.tolist()
    out: Column = F.col("embedding").cast("array<double>")
    base = out
    for c in pc:
        direction = F.array(*map(F.lit, c))
        share = dot(base, direction)
        out = F.zip_with(out, F.transform(direction, _times(share)), lambda x, y: x - y)
    return df.drop("_v").withColumn("embedding", out)


def principal_components(df: DataFrame, n: int) -> DataFrame:
    df = _vector(df)
    return PCA(k=n, inputCol="_v", outputCol="_p").fit(df).transform(df).withColumn("components", vector_to_array("_p")).drop("_v", "_p")


def batch_offsets(df: DataFrame, items: str, order: str, by: list[str] | None = None) -> DataFrame:
    """df with start: how many items the rows before hold. Without `by` sums go by ranges of the order, so that no task has all rows; rows of one order then start at one place."""
    if by:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("start", F.coalesce(F.sum(F.size(items)).over(w), F.lit(0)))
    sums = ranks.running(df, order, measures={"n": F.sum(F.size(items))})
    return ranks.beside(df, sums.select(order, F.col("n_before").alias("start")), [order], "left")


def file_dataset(edges: DataFrame, repos: DataFrame, least: int = 0) -> DataFrame:
    """(repo, file, functions, task) of files' function edges; repos with more than `least` functions."""
    files = edges.where(F.col("edge_type") == "file-function").groupBy("repo", F.col("source").alias("file")).agg(F.array_sort(F.collect_set("destination")).alias("functions"))
    n = F.sum(F.size("functions")).over(Window.partitionBy("repo"))
    files = files.withColumn("_n", n).where(F.col("_n") > least).drop("_n")
    return files.join(repos.select("repo", F.explode("tasks").alias("task")), "repo").distinct()


def save_model(model, path: str) -> None:
    """A fitted model in MLlib's format, over what is there."""
    model.write().overwrite().save(path)


def load_word2vec(path: str):
    from pyspark.ml.feature import Word2VecModel

    return Word2VecModel.load(path)


def hyperbolic_components(df: DataFrame, n: int) -> DataFrame:
    """Multidimensional scaling of hyperbolic distances: rows (id, distances) to all ids in one order, whose -cosh is reduced to n principal components."""
    rows = df.withColumn("embedding", F.transform("distances", lambda x: -F.cosh(x.cast("double"))))
    return principal_components(rows, n).drop("embedding")


def walks(edges: DataFrame, per_node: int = 4, length: int = 8, seed: int = 0) -> DataFrame:
    """(node, walk, path): seeded random walks over the edges from each node, a join for each step; a walk ends where no edge leaves. Each node's edges are numbered, and a walk finds the one it draws by its number, so the
    edges of a node are never in one row."""
    pairs = edges.select(F.col("source").alias("_at"), F.col("target").alias("_to")).distinct()
    out = pairs.withColumn("_i", F.row_number().over(Window.partitionBy("_at").orderBy("_to")) - 1)
    degree = pairs.groupBy("_at").agg(F.count("*").alias("_n"))
    now = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    now = now.select("node", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("walk"), F.array("node").alias("path"))
    for step in range(1, length):
        here = now.withColumn("_at", F.element_at("path", -1)).join(degree, "_at", "left")
        drawn = here.withColumn("_i", F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "node", "walk"), "_n").cast("int"))
        ahead = drawn.join(out, ["_at", "_i"], "left")
        now = ahead.select("node", "walk", F.when(F.col("_to").isNull() | (F.size("path") < step), F.col("path")).otherwise(F.array_append("path", F.col("_to"))).alias("path"))
    return now


def node_vectors(edges: DataFrame, size: int = 32, seed: int = 0, **options) -> DataFrame:
    """(word, vector) of each node by word2vec over random walks."""
    paths = walks(edges, seed=seed, **options).select(F.array_join("path", "\x01").alias("_p"))
    return vectors(train_word2vec(paths, "_p", size=size, least=1, seed=seed, tokens=lambda c: F.split(c, "\x01")))


def nearest_nodes(df: DataFrame, queries: DataFrame, k: int, key: str = "word") -> DataFrame:
    """(query, key, distance): the k rows nearest to each query by Euclidean distance of `vector`, itself left out.

    By products: the nearest have the highest q.x - |x| ** 2 / 2, which is a product of vectors one longer.
    """
    from tesserae.operators.retrieval import dense

    half = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x / 2)
    longer = df.select(F.col(key).alias("doc_id"), F.concat(F.col("vector").cast("array<double>"), F.array(-half)).alias("embedding"))
    asked = queries.select(F.col(key).alias("query_id"), F.concat(F.col("vector").cast("array<double>"), F.array(F.lit(1.0))).alias("embedding"))
    found = dense(longer, asked, k + 1, normalise=False).where("query_id <> doc_id")
    size = queries.select(F.col(key).alias("query_id"), (2 * half).alias("_s"))
    near = found.join(size, "query_id").select(F.col("query_id").alias("query"), F.col("doc_id").alias(key), F.sqrt(F.greatest(F.col("_s") - 2 * F.col("score"), F.lit(0.0))).alias("distance"))
    w = Window.partitionBy("query").orderBy("distance", key)
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")

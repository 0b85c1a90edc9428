"""Distances between the nodes of a graph: from many sources at once, as a stored table, and as coordinates by landmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.operators.embedding import principal_components
from tesserae.operators.relational import integer_ids
from tesserae.plans.durable import Steps, materialize

#: Sources that go through the graph together, one bit each.
BITS = 64


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, distance) of the undirected graph, breadth first from all sources (node) at once, until no node is new.

    64 sources share a long, one bit each: a node's row says which of them have reached it, and a step hands on the bits that are new there, merged by node before they are shuffled. So a step costs an edge once for 64
    sources, and the state is a row for each node and group of sources, which replaces that of the step before. Nodes out of reach have no row; a source without an edge reaches itself. Null nodes are left out.
    """
    spark = edges.sparkSession
    step = Steps(spark)
    known = edges.where("source IS NOT NULL AND target IS NOT NULL AND source <> target")
    both = step(known.select(F.col("source").alias("a"), F.col("target").alias("b")).union(known.select("target", "source")).distinct(), "edges")
    numbered = integer_ids(sources.select("node"), "node").select(F.col("node").alias("source"), F.floor(F.col("id") / BITS).alias("g"), (F.col("id") % BITS).cast("int").alias("bit"))
    numbered = step(numbered, "sources")
    bits = F.expr("shiftleft(1L, bit)").alias("fresh")
    state = numbered.select(F.col("source").alias("node"), "g", bits).withColumn("seen", F.col("fresh")).withColumn("levels", F.array(F.struct(F.lit(0).alias("distance"), F.col("fresh").alias("bits"))))
    state = step(state.select("node", "g", "seen", "fresh", "levels"), "state")
    distance = 0
    while not state.where("fresh <> 0").isEmpty():
        distance += 1
        sent = state.where("fresh <> 0").select(F.col("node").alias("a"), "g", "fresh").join(both, "a").groupBy(F.col("b").alias("node"), "g").agg(F.bit_or("fresh").alias("got"))
        met = state.drop("fresh").join(sent, ["node", "g"], "full_outer")
        seen, got = F.coalesce("seen", F.lit(0).cast("long")), F.coalesce("got", F.lit(0).cast("long"))
        fresh = got.bitwiseAND(F.bitwise_not(seen))
        held = F.coalesce("levels", F.array().cast(state.schema["levels"].dataType))
        levels = F.when(fresh != 0, F.array_append(held, F.struct(F.lit(distance).alias("distance"), fresh.alias("bits")))).otherwise(held)
        last, state = state, step(met.select("node", "g", seen.bitwiseOR(got).alias("seen"), fresh.alias("fresh"), levels.alias("levels")), "state")
        step.drop(last)
    flat = state.select("node", "g", F.explode("levels").alias("l"))
    each = flat.select("node", "g", F.col("l.distance").alias("distance"), F.explode(F.expr(f"filter(sequence(0, {BITS - 1}), b -> (shiftrightunsigned(l.bits, b) & 1L) = 1L)")).alias("bit"))
    out = materialize(each.join(numbered, ["g", "bit"]).select("source", "node", "distance"), "distances")
    step.drop()
    return out


class Matrix:
    """Distances between all nodes of an undirected graph, whole, without a row for each pair.

    Nodes with the same neighbours are one class: they are equally far from every other node, and two steps from each other. classes: (node, class, size); between: (source, node, distance) of the classes, each named by its
    smallest node. So what is computed and stored grows with the square of the classes, not of the nodes.
    """

    def __init__(self, classes: DataFrame, between: DataFrame):
        self.classes, self.between = classes, between

    def write(self, path: str) -> None:
        """Both tables sorted, in files of neighbouring nodes: a row of the matrix is read by a filter that Parquet's statistics answer."""
        self.classes.repartitionByRange("class").sortWithinPartitions("class", "node").write.mode("overwrite").parquet(f"{path}/classes")
        write_distances(self.between, f"{path}/between")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Matrix:
        return cls(spark.read.parquet(f"{path}/classes"), read_distances(spark, f"{path}/between"))

    def rows(self, sources: list) -> DataFrame:
        """(source, node, distance): all nodes that these can reach."""
        asked = self.classes.where(F.col("node").isin(sources)).select(F.col("node").alias("asked"), F.col("class").alias("source"))
        near = self.between.join(F.broadcast(asked), "source").select(F.col("asked").alias("source"), F.col("source").alias("own"), F.col("node").alias("class"), "distance")
        met = near.join(self.classes.select("node", "class"), "class")
        inside = F.when(F.col("source") == F.col("node"), 0).when(F.col("own") == F.col("class"), 2).otherwise(F.col("distance"))
        return met.select("source", "node", inside.cast("int").alias("distance"))

    def totals(self) -> DataFrame:
        """(source, nodes, total, farthest) of every node: how many it can reach, itself included, the sum of the distances, and the largest."""
        sizes = self.classes.select(F.col("class").alias("node"), "size").distinct()
        met = self.between.join(sizes, "node")
        own = F.col("source") == F.col("node")
        total = F.when(own, 2 * (F.col("size") - 1)).otherwise(F.col("distance").cast("long") * F.col("size"))
        far = F.when(own, F.when(F.col("size") > 1, 2).otherwise(0)).otherwise(F.col("distance").cast("int"))
        summed = met.groupBy(F.col("source").alias("class")).agg(F.sum("size").alias("nodes"), F.sum(total).alias("total"), F.max(far).alias("farthest"))
        return self.classes.select(F.col("node").alias("source"), "class").join(summed, "class").drop("class")


def matrix(edges: DataFrame) -> Matrix:
    """All distances of the undirected graph of these edges (source, target). Neighbours are compared by their number and two sums of 64-bit hashes. Null nodes are left out; one with edges to itself alone reaches itself."""
    nodes = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source"))
    both = materialize(nodes.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "edges")
    hashed = [F.sum(F.xxhash64(F.lit(seed), "b").cast("decimal(20, 0)")).alias(f"h{seed}") for seed in (1, 2)]
    signed = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"), *hashed)
    least = signed.groupBy("n", "h1", "h2").agg(F.min("node").alias("class"), F.count("*").alias("size"))
    alone = nodes.where("a IS NOT NULL").select(F.col("a").alias("node")).distinct().join(signed, "node", "left_anti").select("node", F.col("node").alias("class"), F.lit(1).cast("long").alias("size"))
    classes = materialize(signed.join(least, ["n", "h1", "h2"]).select("node", "class", "size").union(alone), "classes")
    # a shortest way between two classes may go by their smallest nodes alone
    first = classes.where("node = class").select("node")
    kept = both.join(first.withColumnRenamed("node", "a"), "a", "left_semi").join(first.withColumnRenamed("node", "b"), "b", "left_semi")
    return Matrix(classes, shortest_paths(kept.select(F.col("a").alias("source"), F.col("b").alias("target")), first))


def write_distances(distances: DataFrame, path: str) -> None:
    """A distance matrix as a table (source, node, distance), sorted by source, in files of neighbouring sources: a row of the matrix is read by a filter that Parquet's statistics answer."""
    distances.select("source", "node", F.col("distance").cast("short").alias("distance")).repartitionByRange("source").sortWithinPartitions("source", "node").write.mode("overwrite").parquet(path)


def read_distances(spark: SparkSession, path: str, sources: list | None = None) -> DataFrame:
    """The stored matrix, or its rows of these sources."""
    rows = spark.read.parquet(path)
    return rows if sources is None else rows.where(F.col("source").isin(sources))


def landmarks(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(node): n nodes by a seeded hash."""
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).where("node IS NOT NULL").distinct()
    return nodes.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(n)


def hyperbolic_coordinates(edges: DataFrame, n: int, most_landmarks: int = 256, seed: int = 0) -> DataFrame:
    """(node, components): n coordinates of every node by hyperbolic scaling of its distances to a few landmarks.

    Full scaling takes the principal components of the matrix of -cosh(distance), whose rows have as many entries as there are nodes. Here a row has only the columns of the landmarks, so that width, memory and the work of the
    decomposition don't grow with the graph; with a landmark for every node the two agree. A node out of reach of a landmark counts as one step beyond the largest distance there is.
    """
    chosen = landmarks(edges, most_landmarks, seed)
    found = shortest_paths(edges, chosen)
    numbered = integer_ids(chosen, "node").select(F.col("node").alias("source"), F.col("id").cast("int").alias("place"))
    numbered = materialize(numbered, "landmarks")
    width, far = numbered.count(), (found.agg(F.max("distance")).first()[0] or 0) + 1
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).where("node IS NOT NULL").distinct()
    near = found.join(F.broadcast(numbered), "source").groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("place", "distance"))).alias("near"))
    row = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: -F.cosh(F.coalesce(F.try_element_at("near", i), F.lit(far)).cast("double")))
    return principal_components(nodes.join(near, "node", "left").select("node", row.alias("embedding")), n).drop("embedding")


def stress(coordinates: DataFrame, full: DataFrame, key: str = "node") -> DataFrame:
    """(pairs, mean_error): how far pairwise distances of two sets of coordinates are apart on the mean, over the pairs of neighbouring keys; scale and signs of components don't matter."""

    def gaps(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(F.pmod(F.xxhash64(key), F.lit(1024))).orderBy(key)
        last = F.lag("components").over(w)
        gap = F.sqrt(F.aggregate(F.zip_with("components", last, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        return df.select(key, gap.alias("gap")).where("gap IS NOT NULL")

    a, b = gaps(coordinates).withColumnRenamed("gap", "a"), gaps(full).withColumnRenamed("gap", "b")
    both = a.join(b, key)
    scale = both.agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"))
    return both.join(F.broadcast(scale)).agg(F.count("*").alias("pairs"), (F.avg(F.abs(F.col("a") * F.col("ab") / F.col("aa") - F.col("b"))) / F.avg("b")).alias("mean_error"))

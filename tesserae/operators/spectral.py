"""Node vectors from the spectrum of the normalised adjacency matrix, and smoothing of vectors over a graph.

A product of the matrix with a block of vectors is a join of edges with rows of the block and a sum by node, combined within tasks before it is shuffled, so that a node with very many edges is never one row. Only matrices of
the block's width reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.zero_shot import gram, predict
from tesserae.plans.durable import Steps, materialize


#: Products between two times that the block is made orthonormal.
PRODUCTS = 3


def normalised(edges: DataFrame) -> DataFrame:
    """(a, b, w): both directions of every edge once, with 1 / sqrt(degree of a * degree of b). Loops and null ends are left out."""
    known = edges.where("source IS NOT NULL AND target IS NOT NULL AND source <> target")
    both = known.select(F.col("source").alias("a"), F.col("target").alias("b")).union(known.select("target", "source")).distinct()
    degree = both.groupBy("a").agg(F.count("*").alias("d"))
    return both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b").select("a", "b", (1 / F.sqrt(F.col("d") * F.col("e"))).alias("w"))


def product(matrix: DataFrame, block: DataFrame, width: int) -> DataFrame:
    """(node, x): the matrix (a, b, w) times the block (node, x) of vectors so wide."""
    rows = matrix.join(block.select(F.col("node").alias("b"), "x"), "b")
    return rows.groupBy(F.col("a").alias("node")).agg(F.array(*(F.sum(F.col("w") * F.col("x")[i]) for i in range(width))).alias("x"))


def _orthonormal(block: DataFrame) -> tuple[DataFrame, int]:
    """The block's columns made orthonormal, without directions that it lacks."""
    values, vectors = np.linalg.eigh(gram(block, "x", "x"))
    kept = values > 1e-12 * max(values.max(), 1e-300)
    return predict(block, vectors[:, kept] / np.sqrt(values[kept]), "x", "_q").select("node", F.col("_q").alias("x")), int(kept.sum())


def spectral_vectors(edges: DataFrame, size: int, more: int = 8, steps: int = 4, seed: int = 0) -> DataFrame:
    """(node, vector): each node's entries of the `size` eigenvectors with the largest eigenvalues, each times the root of its eigenvalue's size.

    Randomised: a block of size + more columns of seeded signs is multiplied PRODUCTS times and made orthonormal, `steps` times over, and the matrix is decomposed within the space that it spans. A vector's sign is such that its entry of largest
    size is positive. Without edges there are no rows.
    """
    step = Steps(edges.sparkSession)
    matrix = step(normalised(edges), "matrix")
    width = size + more
    sign = F.array(*((F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "node"), F.lit(2)) * 2 - 1).cast("double") for i in range(width)))
    block = matrix.select(F.col("a").alias("node")).distinct().select("node", sign.alias("x"))
    if matrix.isEmpty():
        step.drop()
        return edges.sparkSession.createDataFrame([], block.withColumnRenamed("x", "vector").schema)
    kept: list[DataFrame] = []
    for _ in range(steps):
        for _ in range(PRODUCTS):
            # half of the identity is mixed in, which takes negative eigenvalues, as large as the positive ones where a graph has two sides, out of the space that is searched
            both = product(matrix, block, width).join(block.select("node", F.col("x").alias("_x")), "node")
            block = step(both.select("node", F.zip_with("x", "_x", lambda a, b: (a + b) / 2).alias("x")), "product")
            if kept:
                step.drop(*kept)
            kept = [block]
        block, width = _orthonormal(block)
        block = step(block, "block")
        step.drop(*kept)
        kept = [block]
    pair = block.join(product(matrix, block, width).select("node", F.col("x").alias("y")), "node")
    inner = gram(pair, "x", "y")
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    best = np.argsort(-values)[: min(size, width)]
    found = step(predict(block, vectors[:, best], "x", "v").select("node", "v"), "vectors")
    ends = found.agg(*(F.max_by(F.col("v")[i], F.struct(F.round(F.abs(F.col("v")[i]), 9), "node")).alias(str(i)) for i in range(len(best)))).first()
    scale = [(1.0 if (ends[i] or 0) >= 0 else -1.0) * math.sqrt(abs(values[b])) for i, b in enumerate(best)]
    out = materialize(found.select("node", F.array(*(F.col("v")[i] * s for i, s in enumerate(scale))).alias("vector")), "node_vectors")
    step.drop()
    return out


def _bessel(n: int, x: float) -> float:
    """The modified Bessel function of the first kind."""
    return sum((x / 2) ** (2 * m + n) / (math.factorial(m) * math.factorial(m + n)) for m in range(40))


def smoothed(edges: DataFrame, vectors: DataFrame, width: int, heat: float = 1.0, order: int = 6) -> DataFrame:
    """(node, vector): exp(-heat * L) times the vectors (node, vector), L the normalised Laplacian, by Chebyshev terms up to `order`: each node's vector mixed with those around it. Nodes without an edge are left out; such
    without a vector have zeros."""
    step = Steps(edges.sparkSession)
    matrix = step(normalised(edges), "matrix")
    nodes = matrix.select(F.col("a").alias("node")).distinct()
    zeros = F.array(*(F.lit(0.0) for _ in range(width)))
    before = step(nodes.join(vectors.select("node", F.col("vector").cast("array<double>").alias("x")), "node", "left").select("node", F.coalesce("x", zeros).alias("x")), "term")
    now = step(product(matrix, before, width), "term")

    def added(total: DataFrame, term: DataFrame, factor: float) -> DataFrame:
        return total.join(term.select("node", F.col("x").alias("_t")), "node").select("node", F.zip_with("x", "_t", lambda s, t: s + F.lit(factor) * t).alias("x"))

    total = step(added(before.select("node", F.transform("x", lambda v: v * _bessel(0, heat)).alias("x")), now, 2 * _bessel(1, heat)), "total")
    for k in range(2, order + 1):
        ahead = product(matrix, now, width).join(before.select("node", F.col("x").alias("_p")), "node").select("node", F.zip_with("x", "_p", lambda a, b: 2 * a - b).alias("x"))
        ahead = step(ahead, "term")
        more = step(added(total, ahead, 2 * _bessel(k, heat)), "total")
        step.drop(before, total)
        before, now, total = now, ahead, more
    out = materialize(total.select("node", F.transform("x", lambda v: v * math.exp(-heat)).alias("vector")), "smoothed")
    step.drop()
    return out

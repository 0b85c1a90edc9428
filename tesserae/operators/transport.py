"""Texts compared by the vectors of their words: word mover's distance, and greedy matching of tokens.

Words get their vectors by a join, and each text is put together again as words with weights and vectors; so the vocabulary never leaves the executors, and a task holds the words of the pairs of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import tokenize

#: Amounts below this count as nothing.
EPSILON = 1e-12


def transport(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> float:
    """The least total cost of moving supply to demand, which have equal sums: shortest augmenting paths in reduced costs, exact up to rounding."""
    n, m = cost.shape
    left, open_ = supply.astype(float).copy(), demand.astype(float).copy()
    flow, rest = np.zeros((n, m)), cost.astype(float).copy()
    while left.max() > EPSILON and open_.max() > EPSILON:
        rows, columns = np.where(left > EPSILON, 0.0, np.inf), np.full(m, np.inf)
        by_row, by_column = np.full(m, -1), np.full(n, -1)
        row_done, column_done = np.zeros(n, bool), np.zeros(m, bool)
        while True:
            i, j = int(np.argmin(np.where(row_done, np.inf, rows))), int(np.argmin(np.where(column_done, np.inf, columns)))
            if not row_done[i] and rows[i] <= (np.inf if column_done[j] else columns[j]):
                row_done[i] = True
                near = rows[i] + rest[i]
                better = ~column_done & (near < columns)
                columns[better], by_row[better] = near[better], i
                continue
            column_done[j] = True
            if open_[j] > EPSILON:
                break
            back = (flow[:, j] > EPSILON) & ~row_done & (columns[j] < rows)
            rows[back], by_column[back] = columns[j], j
        end = columns[j]
        rest[row_done] -= (end - rows[row_done])[:, None]
        rest[:, column_done] += end - columns[column_done]
        np.maximum(rest, 0, out=rest)
        path, at = [], j
        while at >= 0:
            i = int(by_row[at])
            path.append((i, at))
            at = int(by_column[i])
        backward = [(path[k][0], path[k + 1][1]) for k in range(len(path) - 1)]
        amount = min(left[path[-1][0]], open_[j], *(flow[b] for b in backward))
        for p in path:
            flow[p] += amount
        for b in backward:
            flow[b] -= amount
        left[path[-1][0]] -= amount
        open_[j] -= amount
    return float((flow * cost).sum())


def _bag(rows: DataFrame, text: str, vectors: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """(_id, bag): the words of a text that have a vector, each with how often it stands there."""
    words = rows.select("_id", F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("word")).groupBy("_id", "word").agg(F.count("*").alias("n"))
    found = words.join(vectors.select("word", F.col("vector").cast("array<double>").alias("v")), "word")
    return found.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("word", "n", "v"))).alias("bag"))


def _with_bags(pairs: DataFrame, a: str, b: str, vectors: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    rows = pairs.withColumn("_id", F.xxhash64(F.coalesce(F.col(a), F.lit("")), F.lit("\0"), F.coalesce(F.col(b), F.lit(""))))
    texts = rows.select("_id", a, b).distinct()
    out = rows
    for c, name in ((a, "_a"), (b, "_b")):
        bag = _bag(texts, c, vectors, tokens).select("_id", *(F.col(f"bag.{f}").alias(f"{name}_{f}") for f in ("n", "v")))
        out = out.join(bag, "_id", "left")
    return out.drop("_id")


def _arrays(n, v) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(n, float), np.stack([np.asarray(x, float) for x in v])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T
    return np.sqrt(np.maximum(gap, 0))


def word_mover(pairs: DataFrame, a: str, b: str, vectors: DataFrame, most: float | None = None, tokens: Callable[[Column], Column] = tokenize) -> DataFrame:
    """pairs with wmd, the word mover's distance of two texts by Euclidean distance of word vectors (word, vector), and wmd_bound, a lower bound of it.

    The bound lets every word go to its nearest one, from either side, and takes the larger. Where it is beyond `most`, nothing is transported and wmd is null. Words without a vector are left out; a pair of which a text has no
    word left has null in both. Equal pairs of texts have equal values. Time grows with the cube of a text's different words.
    """

    @F.pandas_udf("wmd double, wmd_bound double")
    def measure(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for an, av, bn, bv in batches:
            out = []
            for n, v, m, w in zip(an, av, bn, bv):
                if n is None or m is None:
                    out.append((None, None))
                    continue
                (n, v), (m, w) = _arrays(n, v), _arrays(m, w)
                n, m, cost = n / n.sum(), m / m.sum(), _distances(v, w)
                bound = max(float(n @ cost.min(axis=1)), float(m @ cost.min(axis=0)))
                out.append((None if most is not None and bound > most else transport(cost, n, m), bound))
            yield pd.DataFrame(out, columns=["wmd", "wmd_bound"], dtype="float64")

    bags = _with_bags(pairs.drop("wmd", "wmd_bound"), a, b, vectors, tokens)
    got = bags.withColumn("_m", measure("_a_n", "_a_v", "_b_n", "_b_v"))
    return got.select(*(c for c in pairs.columns if c not in ("wmd", "wmd_bound")), "_m.wmd", "_m.wmd_bound")


def token_match(pairs: DataFrame, reference: str, generated: str, vectors: DataFrame, tokens: Callable[[Column], Column] = tokenize) -> DataFrame:
    """pairs with precision, recall and f1 of matching every token to the other text's most similar one, by cosine of their vectors (word, vector): precision over the generated text's tokens, recall over the reference's.

    Tokens without a vector, or with one of zeros, are left out; where a text has none left all three are null.
    """

    @F.pandas_udf("precision double, recall double, f1 double")
    def measure(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for rn, rv, gn, gv in batches:
            out = []
            for n, v, m, w in zip(rn, rv, gn, gv):
                if n is None or m is None:
                    out.append((None, None, None))
                    continue
                (n, v), (m, w) = _arrays(n, v), _arrays(m, w)
                s = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (w / np.linalg.norm(w, axis=1, keepdims=True)).T
                recall, precision = float(n @ s.max(axis=1) / n.sum()), float(m @ s.max(axis=0) / m.sum())
                out.append((precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0))
            yield pd.DataFrame(out, columns=["precision", "recall", "f1"], dtype="float64")

    known = vectors.where(F.exists("vector", lambda x: x != 0))
    names = ("precision", "recall", "f1")
    got = _with_bags(pairs.drop(*names), reference, generated, known, tokens).withColumn("_m", measure("_a_n", "_a_v", "_b_n", "_b_v"))
    return got.select(*(c for c in pairs.columns if c not in names), "_m.*")

"""Graphs of repositories as edge tables."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.relational import degrees, recode
from tesserae.plans.durable import Steps

#: The sections of a dependency signature.
SECTIONS = ("repo-file", "file-import", "file-class", "file-function")


def collapse(edges: DataFrame) -> DataFrame:
    """(repo_name, source, target), parallel edges once."""
    return edges.select("repo_name", "source", "target").distinct()


def pagerank_arrays(source: np.ndarray, target: np.ndarray, n: int, damping: float = 0.85, tolerance: float = 1e-6, limit: int = 100) -> np.ndarray:
    """Power iteration with dangling mass spread evenly, until the change in sum is below n * tolerance."""
    out = np.bincount(source, minlength=n)
    share = 1 / np.maximum(out, 1)
    dangling = out == 0
    x = np.full(n, 1 / n)
    for _ in range(limit):
        new = damping * (np.bincount(target, weights=(x * share)[source], minlength=n) + x[dangling].sum() / n) + (1 - damping) / n
        if np.abs(new - x).sum() < n * tolerance:
            return new
        x = new
    raise ArithmeticError(f"no convergence in {limit} steps")


def pagerank(edges: DataFrame, **options) -> DataFrame:
    """(repo_name, node, centrality_score) by repo: graphs of one repo are small, and each is ranked whole where it lies. For one large graph see pagerank_global."""

    def rank(frame: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([frame["source"], frame["target"]]), return_inverse=True)
        m = len(frame)
        pairs = np.unique(np.stack([at[:m], at[m:]]), axis=1)
        return pd.DataFrame({"repo_name": frame["repo_name"].iloc[0], "node": names, "centrality_score": pagerank_arrays(pairs[0], pairs[1], len(names), **options)})

    kind = edges.schema["repo_name"].dataType.simpleString()
    return edges.select("repo_name", "source", "target").groupBy("repo_name").applyInPandas(rank, f"repo_name {kind}, node string, centrality_score double")


def pagerank_global(edges: DataFrame, steps: int = 100, damping: float = 0.85, tolerance: float = 1e-6, article: bool = False) -> DataFrame:
    """(node, rank) over all edges, by joins, until the change in sum is below n * tolerance or after so many steps. Each step is made durable, as the next reads it twice, and the last one goes.

    Nodes without an edge towards them all have one rank, a number that the driver keeps; what their edges bring to each target in times of it is summed up once, so that steps have the other edges only.

    article: rank spread over a node's edges plus the mean number of edges, which takes weight from nodes with few; what isn't spread is lost, so ranks don't add up to 1.
    """
    step = Steps(edges.sparkSession)
    pairs = step(edges.select("source", "target").distinct(), "pairs")
    ends = pairs.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(pairs.select("target", F.lit(0), F.lit(1)))
    known = F.col("node").isNotNull()
    nodes = ends.groupBy("node").agg(F.sum("o").alias("out"), F.max("i").alias("i")).select("node", F.when(known & (F.col("out") > 0), F.col("out")).alias("out"), (~known | (F.col("i") > 0)).alias("inner"))
    nodes = step(nodes, "nodes")
    size = nodes.agg(F.count("*").alias("n"), F.sum(F.coalesce("out", F.lit(0))).alias("m"), F.count_if(~F.col("inner")).alias("outer")).first()
    n, extra = max(size.n, 1), (size.m or 0) / max(size.n, 1) if article else 0.0
    leaving = pairs.join(nodes.select(F.col("node").alias("source"), "out", "inner"), "source")
    given = leaving.where("not inner").groupBy("target").agg(F.sum(1 / (F.col("out") + extra)).alias("given"))
    inner = step(leaving.where("inner").select("source", "target"), "inner-pairs")
    start = nodes.where("inner").join(given, F.col("node") == F.col("target"), "left")
    ranks = step(start.select("node", "out", F.coalesce("given", F.lit(0.0)).alias("given"), F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("change")), "ranks")
    step.drop(pairs)
    first = 1.0 / n
    for _ in range(steps):
        loose = 0.0 if article else ranks.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sent = inner.join(ranks.where("out is not null").select(F.col("node").alias("source"), (F.col("rank") / (F.col("out") + extra)).alias("_sent")), "source").groupBy("target").agg(F.sum("_sent").alias("_in"))
        new = damping * (F.coalesce("_in", F.lit(0.0)) + F.col("given") * first + loose / n) + (1 - damping) / n
        old, ranks = ranks, step(ranks.join(sent, ranks["node"] == sent["target"], "left").select("node", "out", "given", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")), "ranks")
        step.drop(old)
        last, first = first, damping * loose / n + (1 - damping) / n
        if (ranks.agg(F.sum("change")).first()[0] or 0.0) + size.outer * abs(first - last) < n * tolerance:
            break
    step.drop(inner)
    return ranks.select("node", "rank").unionAll(nodes.where("not inner").select("node", F.lit(first).alias("rank")))


def degree(edges: DataFrame) -> DataFrame:
    """(repo_name, node, centrality_score): edges in and out of the collapsed graph; a loop counts twice."""
    one = collapse(edges)
    ends = one.select("repo_name", F.col("source").alias("node")).unionAll(one.select("repo_name", F.col("target").alias("node")))
    return ends.groupBy("repo_name", "node").agg(F.count("*").cast("double").alias("centrality_score"))


METHODS = {"pagerank": pagerank, "degree": degree}


def _ends(edges: DataFrame) -> DataFrame:
    order = F.col("ordinal") if "ordinal" in edges.columns else F.lit(0)
    both = [edges.select("repo_name", F.col(c).alias("node"), "edge_type", F.lit(c).alias("role"), (2 * order + i).alias("place")) for i, c in enumerate(("source", "target"))]
    return both[0].unionAll(both[1])


def node_metadata(edges: DataFrame) -> DataFrame:
    """(repo_name, node, node_edge_type, node_role): sorted types and roles of a node's edges, joined by commas."""

    def joined(c: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(c)), ",")

    return _ends(edges).groupBy("repo_name", "node").agg(joined("edge_type").alias("node_edge_type"), joined("role").alias("node_role"))


def centralities(edges: DataFrame, top: dict[str, int | None] | list[str], k: int | None = 10, method: str = "pagerank") -> DataFrame:
    """Highest-ranking nodes of each repo with their metadata.

    top a map: that many (None: all) nodes for each edge type, with edge_type. top a list: the k highest among nodes of these types, without edge_type. Both ends of an edge
    qualify. Ties keep the order in which edges come (ordinal, source before target), then the name's.
    """
    types = list(top)
    by = ["repo_name", "edge_type"] if isinstance(top, dict) else ["repo_name"]
    # one row for each node and type of its edges: metadata and order come from these, and edges are read once for them
    ends = _ends(edges).groupBy("repo_name", "node", "edge_type").agg(F.min("place").alias("place"), F.collect_set("role").alias("roles"))
    meta = ends.groupBy("repo_name", "node").agg(
        F.array_join(F.array_sort(F.collect_set("edge_type")), ",").alias("node_edge_type"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("roles")))), ",").alias("node_role"),
        F.collect_list(F.struct("edge_type", "place")).alias("_types"),
    )
    scored = METHODS[method](edges).join(meta, ["repo_name", "node"])
    wanted = F.filter("_types", lambda t: t["edge_type"].isin(types))
    columns = ["repo_name", "node", "centrality_score", "node_edge_type", "node_role"]
    if isinstance(top, dict):
        ranked = scored.select(*columns, F.inline(wanted))
    else:
        ranked = scored.select(*columns, F.array_min(F.transform(wanted, lambda t: t["place"])).alias("place")).where("place is not null")
    w = Window.partitionBy(*by).orderBy(F.desc("centrality_score"), "place", "node")
    ranked = ranked.withColumn("_r", F.row_number().over(w))
    if isinstance(top, dict):
        most = F.create_map(*(x for t in types for x in (F.lit(t), F.lit(top[t]).cast("int"))))[F.col("edge_type")]
        ranked = ranked.where(most.isNull() | (F.col("_r") <= most))
    elif k is not None:
        ranked = ranked.where(F.col("_r") <= k)
    return ranked.select("repo_name", "node", "centrality_score", *by[1:], "node_edge_type", "node_role")


def dependency_signatures(central: DataFrame, sections: tuple[str, ...] = SECTIONS, n: int = 10, distinct: bool = False) -> DataFrame:
    """(repo, dependency_signature): `repo: name`, then each section's n highest nodes; sections without nodes are left out.

    A node that `central` has several times takes several places, as in the original; distinct takes it once.
    """
    rows = central.select("repo_name", "node", "centrality_score", F.explode(F.split("node_edge_type", ",")).alias("section"))
    rows = rows.distinct() if distinct else rows
    w = Window.partitionBy("repo_name", "section").orderBy(F.desc("centrality_score"), "node")
    rows = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "node"))), lambda s: s["node"]), ", ")
    blocks = rows.groupBy("repo_name", "section").agg(text.alias("nodes")).groupBy("repo_name").agg(F.map_from_entries(F.collect_list(F.struct("section", "nodes"))).alias("m"))
    parts = [F.concat(F.lit(f"{s}:\n"), F.col("m")[s]) for s in sections]
    return blocks.select(F.col("repo_name").alias("repo"), F.concat_ws("\n\n", F.concat(F.lit("repo: "), F.col("repo_name").cast("string")), *parts).alias("dependency_signature"))


def with_signatures(repos: DataFrame, signatures: DataFrame) -> DataFrame:
    return repos.join(signatures, "repo")


def repository_signature(dependency: Column, tasks: Column) -> Column:
    return F.concat(dependency, F.lit("\ntasks:\n"), tasks)


def expanded_signatures(df: DataFrame) -> DataFrame:
    """repo, tasks and dependency signature as one text, once for each repo (the first by tasks), by repo."""
    text = F.concat(F.lit("repo:\n"), F.col("repo"), F.lit("\ntasks:\n"), F.col("tasks"), F.lit("\nimportant nodes:\n"), F.col("dependency_signature"))
    w = Window.partitionBy("repo").orderBy("tasks", "dependency_signature")
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("repo", "tasks", "dependency_signature", text.alias("repository_signature")).orderBy("repo")


def components(edges: DataFrame, limit: int = 50) -> DataFrame:
    """(node, component) of the undirected graph: the smallest reachable node, by repeated minima, each made durable."""
    step = Steps(edges.sparkSession)
    both = step(edges.select("source", "target").union(edges.select("target", "source")).distinct(), "edges")
    labels = step(both.select(F.col("source").alias("node"), F.col("source").alias("component"), F.col("source").alias("_old")).distinct(), "labels")
    for _ in range(limit):
        near = both.join(labels, F.col("target") == F.col("node")).groupBy("source").agg(F.min("component").alias("_m"))
        new = labels.join(near, labels["node"] == near["source"], "left").select("node", F.least("component", F.coalesce("_m", "component")).alias("component"), F.col("component").alias("_old"))
        # a step on: the component of the component
        jump = new.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        last, labels = labels, step(new.join(jump, F.col("component") == F.col("_n")).select("node", F.col("_c").alias("component"), "_old"), "labels")
        step.drop(last)
        if labels.where("component <> _old").isEmpty():
            step.drop(both)
            return labels.select("node", "component")
    raise ArithmeticError(f"components not settled in {limit} steps")


def out_neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, neighbours): sorted targets of the nodes' edges."""
    return edges.join(nodes.select(F.col("node").alias("source")).distinct(), "source", "left_semi").groupBy(F.col("source").alias("node")).agg(F.array_sort(F.collect_set("target")).alias("neighbours"))


def subgraph(edges: DataFrame, repo) -> DataFrame:
    """A repo's edges with its nodes numbered anew from 0."""
    return recode(edges.where(F.col("repo_name") == repo))


def prune(edges: DataFrame, least: int = 2) -> DataFrame:
    """Edges of which both ends have a total degree of at least `least`."""
    kept = degrees(edges).where(F.col("degree") >= least).select("node")
    return edges.join(kept, edges["source"] == kept["node"], "left_semi").join(kept, edges["target"] == kept["node"], "left_semi")


def typed_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("count"))


def repo_task_edges(repos: DataFrame) -> DataFrame:
    """(task, repos): sorted."""
    return repos.select(F.explode("tasks").alias("task"), "repo").groupBy("task").agg(F.array_sort(F.collect_set("repo")).alias("repos"))

"""Whole flows of the pipeline, from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import code, generation, graph, metrics, relational, retrieval, sampling


def signatures_of_files(files: DataFrame, top: int = 10, method: str = "pagerank") -> DataFrame:
    """(repo, dependency_signature) of Python files: edges, ranks, highest nodes of each type, text."""
    edges = code.extract_edges(files)
    return graph.dependency_signatures(graph.centralities(edges, dict.fromkeys(graph.SECTIONS, top), method=method))


def librarian(repos: DataFrame, signatures: DataFrame, shots: int = 3, generator: generation.Generator = generation.echo, seed: int = 0) -> DataFrame:
    """(repo, generated_tasks, dependency_signature, repository_signature): tags for each repo from examples of others."""
    rows = repos.select("repo", F.array_join("tasks", ", ").alias("tasks")).join(signatures.select("repo", F.col("dependency_signature").alias("signature")), "repo")
    context = generation.with_context(sampling.few_shot_context(rows, shots, seed), rows, ["signature", "tasks"])
    prompted = rows.join(context, "repo", "left").withColumn("context", F.coalesce("context", F.array().cast("array<struct<signature:string,tasks:string>>")))
    prompted = prompted.withColumn("_prompt", generation.few_shot_prompt(F.col("context"), F.col("signature"), "Based on the examples, give tags for the last repository."))
    out = generation.generate(prompted, "_prompt", generator, "generated_tasks")
    return out.select("repo", "generated_tasks", F.col("signature").alias("dependency_signature"), graph.repository_signature(F.col("signature"), F.col("generated_tasks")).alias("repository_signature"), "error")


def evaluate(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, retrievers: dict, k: int = 100) -> DataFrame:
    """Hits, accuracy and precision of every query, corpus and retriever, as one long table. retrievers: name -> function of (docs, queries) to results."""
    names = [r[0] for r in corpus.select("corpus").distinct().orderBy("corpus").collect()]
    found = []
    for name, f in retrievers.items():
        for c in names:
            found.append(retrieval.top_k(f(corpus.where(F.col("corpus") == c).select("doc_id", "text"), queries), k).select(F.lit(c).alias("corpus"), F.lit(name).alias("retriever"), "query_id", "doc_id", "score"))
    return metrics.per_query(relational.union_all(found), qrels, by=["corpus", "retriever"])

"""Schemas of the tables that operators take and give, and the check of what they need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PYTHON_FILES = "path string, content string, repo_name string"
EDGES = "repo_name string, target string, source string, edge_type string"
CENTRALITIES = "repo_name string, node string, centrality_score double, edge_type string, node_edge_type string, node_role string"
SIGNATURES = "repo_name string, path string, function_name string, function_signature string"
FUNCTIONS = "repo_name string, path string, function_name string, function_code string"
PAPER_LINKS = "paper_url string, paper_title string, repo_url string"
PAPERS = "paper_url string, title string, abstract string, tasks array<string>, arxiv_id string, authors array<string>"
REPOS = "repo string, paper_urls array<string>, paper_titles array<string>, titles array<string>, arxiv_ids array<string>, authors array<string>, tasks array<string>, readme string"
AREA_TASKS = "area string, task string"
CORPUS = "corpus string, doc_id string, title string, text string"
QUERIES = "query_id string, query string"
QRELS = "query_id string, doc_id string, rel int"
RESULTS = "query_id string, doc_id string, score double"
EXPERIMENT = "true_tasks array<string>, generated_text string, repo string, generation int"
MATCH = "struct<text: string, line_start: int, line_end: int, match_type: string>"


def struct(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


def require(df: DataFrame, schema: str, types: bool = False) -> DataFrame:
    """df, if it has the schema's columns (with types: of its types); else ValueError names what is wrong."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in struct(schema) if f.name not in have or types and have[f.name] != f.dataType]
    if wrong:
        raise ValueError(f"missing or of another type: {', '.join(wrong)}; there are {', '.join(f'{k} {v.simpleString()}' for k, v in have.items())}")
    return df

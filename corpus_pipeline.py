"""A corpus pipeline of five stages, each written and read again as Parquet: bad text goes, common lines go, one document of each group of near copies stays, sources are mixed, and the rest is packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import line_dedup, mixing, ngram_join, packing, quality_classifier
from tesserae.llm.common import Steps, fresh

#: Documents that are packed together: after each so many, sequences have the shares of the mixture.
WINDOW = 2048


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns of these names, which an operator would replace, under others; and what they are called meanwhile."""
    clash = [c for c in docs.columns if c.lower() in names]
    moved = dict(zip(clash, fresh(docs, *(f"_aside_{i}" for i in range(len(clash))))))
    return docs.withColumnsRenamed(moved), moved


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from these documents' labels, scores 0.5 or more.

    Null texts are scored as empty, every row by itself, so repeated rows stay or go together; without labels of both classes all have one score. All columns stay as they are, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit(quality_classifier.sample(docs, labels))
    score, predicted = fresh(docs, "_score", "_predicted")
    return quality_classifier.score(docs, model, (score, predicted)).where(F.col(predicted) == 1).drop(score, predicted)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in ten documents or more go; n_chars follows the text.

    A null text becomes an empty one. Rows of one doc_id count once for a line, and what goes goes from every row; no row is lost, other columns stay as they are.
    """
    moved, names = _aside(docs, "n_lines", "n_dropped")
    out = line_dedup.dedup(moved)
    return out.select(*(F.length("text").cast(f.dataType).alias(f.name) if f.name.lower() == "n_chars" else F.col(f"`{names.get(f.name, f.name)}`").cast(f.dataType).alias(f.name) for f in docs.schema))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies stays.

    Texts that are null, empty or without words are nobody's copies; all rows of a doc_id that stays do, repeated ones too, and rows with a null doc_id. Columns stay as they are.
    """
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture, all rows and columns as they are.

    A null source is one of its own; rows that tie in doc_id take neighbouring places. The order of rows doesn't outlast Parquet: places depend on the documents only, and packing finds them again.
    """
    return mixing.ordered(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences that follow the mixture by sequence_id; every row is packed by itself, a null or empty text as its end id alone. Only doc_id, source and text are read."""
    return packing.pack_in_order(mixing.mix(packing.pieces(docs)), window=WINDOW)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Compression and networks of links aren't SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, step, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), Steps(spark), None
    for name, stage in STAGES[:-1]:
        docs = step(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            step.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from tesserae.llm import decontaminate, divergence, langid, licenses, line_dedup, mixing, ngram_join, packing, pfor, quality_classifier, quality_rules, simhash, vector_codes
from tesserae.llm.common import documents


def op1_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


def op2_token_files(spark, sf_dir):
    return pfor.round_trip(documents(spark, sf_dir))


def op3_license_scan(spark, sf_dir):
    got = licenses.scan(documents(spark, sf_dir))
    return got.selectExpr("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "size(spans) AS n_spans")


def op4_ngram_join(spark, sf_dir):
    return ngram_join.join(documents(spark, sf_dir))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.score(documents(spark, sf_dir))


def op6_fingerprints(spark, sf_dir):
    return simhash.report(documents(spark, sf_dir), radius=simhash.RADIUS)


def op7_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_language(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.digest(documents(spark, sf_dir))


def op10_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "source"))


def op11_vector_codes(spark, sf_dir):
    return vector_codes.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_source_divergence(spark, sf_dir):
    return divergence.audit(documents(spark, sf_dir))


def op13_decontamination(spark, sf_dir):
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_token_files, op3_license_scan, op4_ngram_join, op5_quality_rules, op6_fingerprints, op7_quality_classifier, op8_language, op9_line_dedup, op10_mixing, op11_vector_codes, op12_source_divergence, op13_decontamination)}
SQL: dict[str, str] = {"op9_line_dedup": line_dedup.SQL, "op10_mixing": mixing.SQL, "op11_vector_codes": vector_codes.SQL, "op12_source_divergence": divergence.SQL, "op13_decontamination": decontaminate.SQL}

"""Queries of this subpackage and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, html_extraction, jaccard_join, packing, quality_classifier, quality_rules, secret_scan, source_mixing, token_output, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        html_extraction.op1_html_extraction,
        token_output.op2_token_output,
        embedding_dedup.op3_embedding_dedup,
        packing.op4_best_fit_packing,
        jaccard_join.op5_ngram_jaccard_join,
        source_mixing.op6_source_mixing,
        secret_scan.op7_secret_scan,
        quality_classifier.op8_quality_classifier,
        quality_rules.op9_quality_rules,
        toxicity.op10_toxicity,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mixing": source_mixing.SQL, "op9_quality_rules": quality_rules.SQL}

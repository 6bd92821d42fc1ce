"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from argil.llm import compression_rules, decontamination, fixity, html_text, mixing, quality, simhash_dedup, substring_dedup, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_boosted_quality": quality.query,
    "op2_fair_queueing": mixing.query,
    "op3_compression_bands": compression_rules.query,
    "op4_simhash_decontamination": decontamination.query,
    "op5_countmin_passages": substring_dedup.query,
    "op6_merkle_fixity": fixity.query,
    "op7_html_rendering": html_text.query,
    "op8_convolutional_toxicity": toxicity.query,
    "op9_viterbi_token_counts": token_counts.query,
    "op10_golay_simhash": simhash_dedup.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_fair_queueing": mixing.ORACLE,
    "op5_countmin_passages": substring_dedup.ORACLE,
    "op6_merkle_fixity": fixity.ORACLE,
}

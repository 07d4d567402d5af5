"""Registry of this subpackage: queries() and oracle_sql()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import collocations, exact_dedup, filter_audit, fingerprints, line_dedup, mixing, near_dedup, packing, quality, simhash, substrings, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": fingerprints.op1_document_fingerprints,
    "op2_quality_cotraining": quality.op2_quality_cotraining,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_collocations": collocations.op11_collocations,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_simhash_dedup": simhash.op13_simhash_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mix_sources": mixing.OP4_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}

"""Queries of this package and the DuckDB SQL of those that SQL can state."""

from __future__ import annotations

from quern.llm import bpe, decontam, jaccard, langid, line_dedup, merkle, mixing, periodic, quality, secrets, suffix_dedup, token_files, topk

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_context_mixing": mixing.op2_context_mixing,
    "op3_token_files": token_files.op3_token_files,
    "op4_exact_top_k": topk.op4_exact_top_k,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_language_id": langid.op7_language_id,
    "op8_bpe": bpe.op8_bpe,
    "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
    "op10_benchmark_decontamination": decontam.op10_benchmark_decontamination,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_quality_rules": quality.op12_quality_rules,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op4_exact_top_k": topk.SQL,
    "op10_benchmark_decontamination": decontam.SQL,
    "op11_merkle_manifest": merkle.SQL,
}

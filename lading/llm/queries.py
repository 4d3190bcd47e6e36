"""Queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from lading.llm import (
    decontaminate,
    filter_audit,
    hard_negatives,
    katz,
    licenses,
    lines,
    minhash,
    mixing,
    pages,
    personal_data,
    quality_classifier,
    quality_rules,
    sharding,
)

QUERIES = {
    "op1_near_duplicates": minhash.op1_near_duplicates,
    "op2_lm_scores": katz.op2_lm_scores,
    "op9_personal_data": personal_data.op9_personal_data,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op6_extract_pages": pages.op6_extract_pages,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op10_shard": sharding.op10_shard,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_license_scan": licenses.op12_license_scan,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}

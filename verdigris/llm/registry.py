"""Queries of the numbered operators and their oracle SQL."""

from __future__ import annotations

from . import html_text, jaccard_join, mixing, phrase_index, quality_model, rules, sharding, substring_dedup, tokens, urls

QUERIES = {
    "op1_decontamination": phrase_index.op1,
    "op2_jaccard_join": jaccard_join.op2,
    "op3_html_extraction": html_text.op3,
    "op4_url_filter": urls.op4,
    "op5_sharding": sharding.op5,
    "op6_quality_classifier": quality_model.op6,
    "op7_token_counts": tokens.op7,
    "op8_quality_rules": rules.op8,
    "op9_source_mixing": mixing.op9,
    "op10_substring_dedup": substring_dedup.op10,
    "sharding_small_limit": sharding.small_shards,
    "quality_rules_sections": rules.sections,
}

ORACLES = {
    "op1_decontamination": phrase_index.ORACLE,
    "op2_jaccard_join": jaccard_join.ORACLE,
    "op3_html_extraction": html_text.ORACLE,
    "op5_sharding": sharding.ORACLE,
    "op8_quality_rules": rules.ORACLE,
    "op9_source_mixing": mixing.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
    "sharding_small_limit": sharding.SMALL_ORACLE,
    "quality_rules_sections": rules.SECTIONS_ORACLE,
}

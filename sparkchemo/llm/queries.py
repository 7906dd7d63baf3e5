"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from sparkchemo.llm import decontaminate, language, lexical_search, line_dedup, lm_score, near_dedup, negatives, packing, quality_model, quality_rules, sharding, suffix_dedup, url_filter

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_language_id": language.op2_language_id,
    "op3_quality_classifier": quality_model.op3_quality_classifier,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_packing": packing.op6_packing,
    "op7_sharding": sharding.op7_sharding,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_lm_scoring": lm_score.op10_lm_scoring,
    "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLE_SQL = {**url_filter.ORACLE, **decontaminate.ORACLE, **quality_rules.ORACLE, **line_dedup.ORACLE, **negatives.ORACLE, **lexical_search.ORACLE}

"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import attribution, conversations, decontamination, jaccard, line_rules, mixing, pages, pii, quality_model, runs, sharding, tokenfile, toxicity

QUERIES = {
    "op1_personal_data": pii.op1_personal_data,
    "op2_main_text": pages.op2_main_text,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_quality": quality_model.op4_quality,
    "op5_line_rules": line_rules.op5_line_rules,
    "op6_mixture": mixing.op6_mixture,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_files": tokenfile.op9_token_files,
    "op10_section_tokens": attribution.op10_section_tokens,
    "op11_sharding": sharding.op11_sharding,
    "op12_runs": runs.op12_runs,
    "op13_conversations": conversations.op13_conversations,
}

ORACLE_SQL = {"op6_mixture": mixing.oracle(), "op11_sharding": sharding.oracle(), "op13_conversations": conversations.oracle()}

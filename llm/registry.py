"""Queries of this package and, where SQL can express them, their DuckDB twins."""

from llm import decontamination, filter_audit, jaccard_join, lm_score, mixing, pii, quality_classifier, quality_rules, secrets, spelling, substring_dedup, toxicity, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_secrets": secrets.op4_secrets,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_warc": warc.op6_warc,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_pii": pii.op9_pii,
    "op10_lm_score": lm_score.op10_lm_score,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op3_quality_rules": quality_rules.ORACLE,
    "op5_jaccard_join": jaccard_join.ORACLE,
    "op6_warc": warc.ORACLE,
    "op8_decontamination": decontamination.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}

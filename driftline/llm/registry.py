"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from driftline.llm import fingerprints, licenses, mixing, near_duplicates, quality_classifier, quality_rules, sentencepieces, substrings, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_mixing": mixing.op2_mixing,
        "op3_sentencepieces": sentencepieces.op3_sentencepieces,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_near_duplicates": near_duplicates.op5_near_duplicates,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_fingerprints": fingerprints.op7_fingerprints,
        "op8_quality_classifier": quality_classifier.op8_quality_classifier,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_substrings": substrings.op10_substrings,
    }


def oracle_sql() -> dict:
    return {
        "op5_near_duplicates": near_duplicates.ORACLE,
        "op6_quality_rules": quality_rules.ORACLE,
        "op10_substrings": substrings.ORACLE,
    }

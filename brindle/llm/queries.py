"""The corpus queries by name, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from brindle.llm import decontaminate, exact_dedup, language_id, line_dedup, near_dedup, packing, substring_dedup, suffix_dedup, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_language_id": language_id.op4_language_id,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op10_line_dedup_far": line_dedup.op10_line_dedup_far,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_near_dedup": near_dedup.ORACLE,
        "op5_suffix_dedup": suffix_dedup.ORACLE,
        "op6_substring_dedup": substring_dedup.ORACLE,
        "op8_exact_dedup": exact_dedup.ORACLE,
        "op9_decontaminate": decontaminate.ORACLE,
        "op10_line_dedup": line_dedup.ORACLE,
    }

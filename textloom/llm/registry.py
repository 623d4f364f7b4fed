"""The queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

from textloom.llm import bpe, conversations, decontaminate, exact, language_model, licenses, pii, quality, simhash, sql, suffixes, token_counts, toxicity, whitening


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_suffix_dedup": suffixes.op2_suffix_dedup,
        "op3_quality": quality.op3_quality,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_language_model": language_model.op5_language_model,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_simhash": simhash.op7_simhash,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_exact_dedup": exact.op9_exact_dedup,
        "op10_license_scan": licenses.op10_license_scan,
        "op11_token_counts": token_counts.op11_token_counts,
        "op12_conversation_repair": conversations.op12_conversation_repair,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_dedup": sql.repeated_passages_sql(),
        "op7_simhash": sql.simhash_sql(),
        "op9_exact_dedup": exact.OP9_SQL,
        "op10_license_scan": sql.license_scan_sql(),
    }

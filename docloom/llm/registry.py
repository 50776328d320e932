"""The corpus operators' queries and SQL by name."""

from __future__ import annotations

from docloom.llm import bpe, exact_dedup, fingerprint, language, licenses, mixing, near_dedup, secrets, token_count, toxicity


def queries() -> dict:
    found = (
        bpe.op1_bpe,
        fingerprint.op2_fingerprint,
        toxicity.op3_toxicity,
        language.op4_language,
        near_dedup.op5_near_dedup,
        secrets.op6_secrets,
        token_count.op7_token_counts,
        mixing.op8_mixing,
        licenses.op9_licenses,
        exact_dedup.op10_exact_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": mixing.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE}

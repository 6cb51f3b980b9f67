"""The queries of this subpackage by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import co_training, decontaminate, hard_negatives, importance_resampling, mixing, parity_join, pseudo_likelihood, quality_rules, secrets, simhash, sql, suffix_dedup, token_output, toxicity

QUERIES = {
    "op10_pseudo_likelihood": pseudo_likelihood.query,
    "op11_parity_join": parity_join.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_importance_resampling": importance_resampling.query,
    "op1_secrets": secrets.query,
    "op2_co_training": co_training.query,
    "op3_token_output": token_output.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_quality_rules": quality_rules.query,
    "op6_decontaminate": decontaminate.query,
    "op7_mixing": mixing.query,
    "op8_toxicity": toxicity.query,
    "op9_simhash": simhash.query,
}

ORACLES = {
    "op11_parity_join": sql.PARITY_JOIN,
    "op12_hard_negatives": sql.HARD_NEGATIVES,
    "op13_importance_resampling": sql.RESAMPLING,
    "op1_secrets": sql.SECRETS,
    "op5_quality_rules": sql.QUALITY_RULES,
    "op7_mixing": sql.MIXING,
}

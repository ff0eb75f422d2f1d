"""The queries of this subpackage and, where SQL can say it, what they must equal."""

from __future__ import annotations

import importlib

#: Module and function of each query; a query's module may hold its SQL as ORACLE.
REGISTERED = {
    "op1_html_extract": "html_extract",
    "op2_gru_lm_score": "lm_score",
    "op3_best_fit_packing": "packing",
    "op4_license_scan": "license_scan",
    "op5_token_orc": "token_orc",
    "op6_language_id": "language_id",
    "op7_benchmark_decontamination": "decontaminate",
    "op8_exact_dedup": "exact_dedup",
    "op9_ngram_jaccard_join": "jaccard_join",
    "op10_chat_format": "chat_format",
    "op11_phrase_mining": "phrases",
    "op12_lsh_forest": "lsh_forest",
    "op13_spelling_variants": "variants",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in REGISTERED.items()}


def oracle_sql() -> dict:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in REGISTERED.items()}
    return {name: sql for name, sql in found.items() if sql}

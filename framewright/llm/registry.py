"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = {
    "op1_suffix_dedup": "op01_suffix_dedup",
    "op2_license_scan": "op02_license",
    "op3_best_fit_packing": "op03_packing",
    "op4_exact_topk": "op04_topk",
    "op5_minhash_dedup": "op05_minhash",
    "op6_secret_scan": "op06_secrets",
    "op7_toxicity": "op07_toxicity",
    "op8_decontaminate": "op08_decontaminate",
    "op9_token_counts": "op09_tokens",
    "op10_url_filter": "op10_url_filter",
    "op11_filter_audit": "op11_filter_audit",
    "op12_spelling_variants": "op12_spelling",
    "op13_mixing": "op13_mixing",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES.values():
        out |= import_module(f"{__package__}.{module}").SQL
    return out

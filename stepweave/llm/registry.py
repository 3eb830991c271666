"""Queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_language_id": "language_id",
    "op2_bpe": "bpe",
    "op7_html_text": "html_text",
    "op3_substring_dedup": "substring_dedup",
    "op4_line_dedup": "line_dedup",
    "op5_jaccard_join": "jaccard_join",
    "op6_sharding": "sharding",
    "op8_fingerprints": "fingerprints",
    "op9_mixing": "mixing",
    "op10_quality_rules": "quality_rules",
    "op11_ranked_search": "ranked_search",
    "op12_bbit": "bbit",
    "op13_clustering": "clustering",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{mod}"), name) for name, mod in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = ((name, getattr(import_module(f"{__package__}.{mod}"), "ORACLE", None)) for name, mod in _MODULES.items())
    return {name: sql for name, sql in found if sql}

"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Module and query function of each operator; a module may hold ORACLE_SQL.
MODULES = {
    "op1_url_filter": "url_filter",
    "op2_line_dedup": "line_dedup",
    "op3_quality": "quality",
    "op4_near_dedup": "near_dedup",
    "op5_language": "language",
    "op6_simhash": "simhash",
    "op7_bpe": "bpe",
    "op8_pii": "pii",
    "op9_top_k": "topk",
    "op10_packing": "packing",
    "op11_repair": "conversations",
    "op12_toxicity": "toxicity",
    "op13_whitening": "whitening",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}

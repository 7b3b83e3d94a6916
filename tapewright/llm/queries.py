"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

# query: module
_WHERE = {
    "op1_bpe": "bpe",
    "op2_simhash": "simhash",
    "op3_mixture": "mixture",
    "op4_quality": "quality",
    "op5_outliers": "outliers",
    "op6_minhash": "minhash",
    "op7_chat": "chat",
    "op8_lines": "lines",
    "op9_suffix": "suffix",
    "op10_toxicity": "toxicity",
    "op11_spelling": "spelling",
    "op12_lloyd": "lloyd",
    "op13_content_sort": "content_sort",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in _WHERE.items()}
    return {name: sql for name, sql in found.items() if sql}

"""Queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = {
    "op1_html": "html",
    "op8_licenses": "licenses",
    "op5_decontamination": "decontaminate",
    "op3_token_counts": "lengths",
    "op7_sharding": "sharding",
    "op9_packing": "packing",
    "op2_language_id": "langid",
    "op4_quality": "quality",
    "op6_minhash": "minhash",
    "op10_exact_dedup": "exact_dedup",
}


def queries() -> dict[str, Callable]:
    return {name: import_module(f"tokloom.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"tokloom.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}

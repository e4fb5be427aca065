"""Queries of this subpackage for the driver, and the SQL of those that SQL can state."""

from __future__ import annotations

import importlib

#: module, function: the function's name is the query's name
OPERATORS = [
    ("pieces", "op1_sentencepiece"),
    ("nearcopies", "op2_minhash_near_dedup"),
    ("urls", "op3_url_filter"),
    ("packing", "op4_best_fit_packing"),
    ("toxicity", "op5_toxicity"),
    ("idfile", "op6_id_files"),
    ("lines", "op7_line_dedup"),
    ("gru", "op8_gru_scores"),
    ("fingerprints", "op9_document_fingerprints"),
    ("topk", "op10_exact_top_k"),
    ("repeats", "op11_periodic_runs"),
    ("maintext", "op12_html_extraction"),
    ("alignment", "op13_token_alignment"),
]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"landlens.llm.{module}"), name) for module, name in OPERATORS}


def oracle_sql() -> dict[str, str]:
    found = {}
    for module, name in OPERATORS:
        sql = getattr(importlib.import_module(f"landlens.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found

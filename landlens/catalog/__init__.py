"""Registered queries, one module per section of the operator inventory."""

from __future__ import annotations

import importlib

SECTIONS = [
    "scans", "projections", "filters", "joins", "aggregates", "contexts", "scalars", "texts", "pages", "incremental",
    "questions", "reports",
]


def load():
    """Import every section and return the filled registry."""
    for section in SECTIONS:
        importlib.import_module(f"{__name__}.{section}")
    return importlib.import_module(f"{__name__}.registry")

"""Named queries over the test tables, each with a DuckDB statement of the same result."""

from __future__ import annotations

import importlib

MODULES = ["tables_queries", "summary_queries", "transaction_queries", "ingest_queries", "layout_queries", "label_queries"]


def load():
    """All queries and oracle statements, in module order."""
    from ledgerloom.catalog.registry import ORACLES, QUERIES

    for module in MODULES:
        importlib.import_module(f"ledgerloom.catalog.{module}")
    return QUERIES, ORACLES

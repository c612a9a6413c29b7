"""Query registry over the driver tables: what runs, and the SQL it must agree with."""

from __future__ import annotations

import importlib

_MODULES = ["search_checks", "catalog_checks", "enrich_checks", "recommend_checks", "ingest_checks"]


def load_all() -> dict:
    """Imports every check module and returns the registered queries."""
    from checks import harness

    for module in _MODULES:
        importlib.import_module(f"checks.{module}")
    return harness.QUERIES

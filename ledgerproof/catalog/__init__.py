"""Queries over the given tables."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "checks", "intake", "splitting", "words", "records", "reviewing", "joblog", "accuracy",
    "maintained",
)


def all_queries():
    """All registered queries by name."""
    for module in MODULES:
        import_module(f"ledgerproof.catalog.{module}")
    from ledgerproof.catalog.core import QUERIES

    return dict(QUERIES)

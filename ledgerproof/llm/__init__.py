"""Operators for large text collections that become training data.

Nothing else in the library imports this package. Each module holds one operator
with its general interface, and the thin query that applies it to the given tables.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "warc", "language", "packing", "quality", "neighbours", "wrappers", "rollup", "setsketch", "pii",
    "bpe", "exact", "resample", "alignment",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The query of each operator by name."""
    found = {}
    for module in MODULES:
        found |= import_module(f"ledgerproof.llm.{module}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    """The SQL twin of each query that SQL can express."""
    found = {}
    for module in MODULES:
        found |= getattr(import_module(f"ledgerproof.llm.{module}"), "SQL", {})
    return found

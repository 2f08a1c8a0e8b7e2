"""Registration of queries over the given tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ledgerproof.session import materialise


class Tables:
    """The tables of one folder, read when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")


#: Written inputs by folder and name, for a caller that prepares them (see `prepared`); else None.
PREPARED: dict[tuple[str, str], DataFrame] | None = None


def derived(fn):
    """Marks an input that is derived from the given tables. It is part of every query's plan, unless
    the caller had it written before."""
    @wraps(fn)
    def of(t: Tables) -> DataFrame:
        key = (t._folder, fn.__name__)
        if PREPARED is None:
            return fn(t)
        if key not in PREPARED:
            PREPARED[key] = materialise(fn(t), f"input-{fn.__name__}")
        return PREPARED[key]

    DERIVED.append(of)
    return of


DERIVED: list[Callable[[Tables], DataFrame]] = []
QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def prepared(t: Tables) -> None:
    """Write all derived inputs of a folder, so that queries read them from then on."""
    global PREPARED
    PREPARED = PREPARED if PREPARED is not None else {}
    for make in DERIVED:
        make(t)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def joined(column, sep: str = "|"):
    """An array of strings as one string, for comparison."""
    from pyspark.sql import functions as F

    return F.array_join(column, sep)

"""Building and reading ordered issue lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerproof.schemas import ISSUE


def issue(rule: str, severity: str, field: str | None, message: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        F.lit(field).cast("string").alias("field"),
        message.alias("message"),
    ).cast(ISSUE)


def issue_list(*conditional: Column) -> Column:
    """Keep the issues whose condition held, in the order given."""
    return F.array_compact(F.array(*conditional))


def given(*columns: Column) -> Column:
    """The structs of these columns that are not null, as a list in the order given.

    The same as `array_compact`, but it runs as generated code. Each column is read twice, so they
    should be columns of an earlier step.
    """
    return F.concat(*[
        F.when(x.isNotNull(), F.array(x)).otherwise(F.slice(F.array(x), 1, 0)) for x in columns
    ])


def has_error(issues: Column) -> Column:
    return F.exists(issues, lambda i: i["severity"] == "error")


def count_severity(issues: Column, severity: str) -> Column:
    return F.size(F.filter(issues, lambda i: i["severity"] == severity))

"""Checks on one record at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerproof.config import CURRENCY_CODES, DEFAULTS, REQUIRED_FIELDS, Settings
from ledgerproof.functions.issues import given, issue, issue_list
from ledgerproof.functions.text import fixed2


def _off(a: Column, b: Column, tolerance: float) -> Column:
    """|a - b| above the tolerance; false for NaN and null.

    NaN sorts above everything in Spark, so it is excluded by hand.
    """
    gap = F.abs(a - b)
    return F.coalesce((gap > tolerance) & ~F.isnan(gap), F.lit(False))


def required_field(field: str, value: Column) -> Column:
    """Null or empty text is missing; blanks and zero are present."""
    empty = value.isNull()
    if field in ("supplier", "invoice_number"):
        empty = empty | (value == "")
    return F.when(
        empty,
        issue("missing_required_field", "error", field,
              F.lit(f"Required field '{field}' is missing")),
    )


def line_sum(items: Column) -> Column:
    """Sum of the amounts in order; NULL when there are none or one is null."""
    complete = (F.size(items) > 0) & F.forall(items, lambda i: i["amount"].isNotNull())
    return F.when(
        F.coalesce(complete, F.lit(False)),
        F.aggregate(items, F.lit(0.0), lambda acc, i: acc + i["amount"]),
    )


def line_items_rule(items: Column, subtotal: Column, tolerance: float) -> Column:
    return _line_total_rule(line_sum(items), subtotal, tolerance)


def _line_total_rule(total: Column, subtotal: Column, tolerance: float) -> Column:
    return F.when(
        _off(total, subtotal, tolerance),
        issue(
            "line_items_subtotal_mismatch", "error", "subtotal",
            F.concat(F.lit("Line items sum to "), fixed2(total),
                     F.lit(" but subtotal is "), fixed2(subtotal)),
        ),
    )


def total_rule(subtotal: Column, tax: Column, total: Column, tolerance: float) -> Column:
    expected = subtotal + tax
    return F.when(
        _off(expected, total, tolerance),
        issue(
            "total_mismatch", "error", "total",
            F.concat(
                F.lit("subtotal ("), fixed2(subtotal), F.lit(") + tax ("), fixed2(tax),
                F.lit(") = "), fixed2(expected), F.lit(" but total is "), fixed2(total),
            ),
        ),
    )


def due_date_rule(invoice_date: Column, due_date: Column) -> Column:
    return F.when(
        due_date < invoice_date,
        issue(
            "due_date_before_invoice_date", "error", "due_date",
            F.concat(F.lit("Due date "), due_date.cast("string"),
                     F.lit(" is before invoice date "), invoice_date.cast("string")),
        ),
    )


def currency_rule(currency: Column) -> Column:
    """Not trimmed: only case is ignored. Empty text is invalid, null is fine."""
    return F.when(
        ~F.upper(currency).isin(*CURRENCY_CODES),
        issue(
            "invalid_currency", "warning", "currency",
            F.concat(F.lit("'"), currency,
                     F.lit("' is not a recognized ISO 4217 currency code")),
        ),
    )


def _rules(record: str, items_total: Column, settings: Settings) -> list[Column]:
    """All rules on a record struct, in their fixed order; `items_total` is the `line_sum`."""
    def col(name):
        return F.col(f"{record}.{name}")

    tolerance = settings.amount_tolerance
    return [
        *[required_field(f, col(f)) for f in REQUIRED_FIELDS],
        _line_total_rule(items_total, col("subtotal"), tolerance),
        total_rule(col("subtotal"), col("tax"), col("total"), tolerance),
        due_date_rule(col("invoice_date"), col("due_date")),
        currency_rule(col("currency")),
    ]


def rule_issues(record: str = "record", settings: Settings = DEFAULTS) -> Column:
    """All rules on a record struct, in their fixed order."""
    return issue_list(*_rules(record, line_sum(F.col(f"{record}.line_items")), settings))


def validate_records(records: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add `rule_issues` to rows with a `record`.

    The same as the column `rule_issues`, in flat steps that run as generated code.
    """
    rows = records.withColumn("items_total", line_sum(F.col("record.line_items")))
    found = {f"issue_{i}": x for i, x in enumerate(_rules("record", F.col("items_total"), settings))}
    rows = rows.withColumns(found)
    return rows.withColumn("rule_issues", given(*[F.col(x) for x in found])).drop(
        "items_total", *found
    )


def issue_rows(records: DataFrame, issues: str, *ids: str) -> DataFrame:
    """One row per issue of the list column `issues`."""
    return records.select(*ids, F.inline(issues))


def issue_profile(issues: DataFrame) -> DataFrame:
    """Issue counts by tenant, rule and severity."""
    return issues.groupBy("tenant_id", "rule", "severity").agg(F.count("*").alias("n_issues"))

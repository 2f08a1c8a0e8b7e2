"""Checks of a record against other documents of its tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerproof.functions.issues import issue
from ledgerproof.functions.text import fold

KEYS = ["tenant_id", "supplier_key", "number_key"]


def latest_attempts(extractions: DataFrame, *columns: str) -> DataFrame:
    """The row with the highest attempt per document.

    One aggregate with map-side combine, rather than an aggregate joined back.
    """
    row = F.struct(*columns)
    return extractions.groupBy("document_id").agg(
        F.max("attempt_no").alias("attempt_no"), F.max_by(row, "attempt_no").alias("row")
    ).select("document_id", "attempt_no", "row.*")


def with_keys(df: DataFrame) -> DataFrame:
    """Add the comparison keys; a null counts as empty text."""
    return df.withColumn("supplier_key", F.coalesce(fold(F.col("supplier")), F.lit(""))).withColumn(
        "number_key", F.coalesce(fold(F.col("invoice_number")), F.lit(""))
    )


def two_smallest(candidates: DataFrame) -> DataFrame:
    """Per key the smallest and second smallest document id.

    The rank filter is applied inside each task before the shuffle, so a key
    shared by very many documents sends two rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy("document_id"))
    return (
        candidates.select(*KEYS, "document_id")
        .withColumn("rank", rank)
        .where("rank <= 2")
        .groupBy(*KEYS)
        .agg(
            F.min("document_id").alias("first_id"),
            F.max(F.when(F.col("rank") == 2, F.col("document_id"))).alias("second_id"),
        )
    )


def current_values(extractions: DataFrame, field_values: DataFrame) -> DataFrame:
    """The duplicate check's view of the current field values, corrections included.

    `extractions` has the latest `extraction_id, document_id, tenant_id` of each document.
    """
    def value(f):
        return F.max(F.when(F.col("field") == f, F.col("value"))).alias(f)

    wanted = field_values.where(F.col("field").isin("supplier", "invoice_number"))
    values = wanted.groupBy("extraction_id").agg(value("supplier"), value("invoice_number"))
    return extractions.select("extraction_id", "document_id", "tenant_id").join(
        values, "extraction_id"
    )


def duplicate_invoices(targets: DataFrame, latest: DataFrame) -> DataFrame:
    """Targets whose (supplier, number) another document of the tenant has.

    `targets` has `extraction_id, document_id, tenant_id, supplier,
    invoice_number`; `latest` has the current values of every document's latest
    attempt. Adds `other_id`, the smallest id among the other documents. The
    join is one row per target whatever the size of a group of equal invoices.
    Its right side has one row per key, so Spark splits a key that holds a
    large share of the targets by itself.
    """
    usable = with_keys(
        targets.where((F.col("supplier") != "") & (F.col("invoice_number") != ""))
    )
    pairs = two_smallest(with_keys(latest))
    joined = usable.join(pairs, KEYS)
    other = F.when(F.col("first_id") != F.col("document_id"), F.col("first_id")).otherwise(
        F.col("second_id")
    )
    return (
        joined.withColumn("other_id", other)
        .where(F.col("other_id").isNotNull())
        .drop("supplier_key", "number_key", "first_id", "second_id")
    )


def earlier_duplicates(targets: DataFrame, latest: DataFrame) -> DataFrame:
    """As `duplicate_invoices`, but only documents created before the target.

    Both sides carry `created_at`. Looking at the earliest other document is
    enough: if any came before the target, that one did.
    """
    usable = with_keys(
        targets.where((F.col("supplier") != "") & (F.col("invoice_number") != ""))
    )
    at = F.struct("created_at", "document_id")
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy("created_at", "document_id"))
    pairs = (
        with_keys(latest).select(*KEYS, at.alias("at")).select(*KEYS, "at", "at.*")
        .withColumn("rank", rank).where("rank <= 2")
        .groupBy(*KEYS)
        .agg(F.min("at").alias("a"), F.max(F.when(F.col("rank") == 2, F.col("at"))).alias("b"))
    )
    joined = usable.join(pairs, KEYS)
    other = F.when(F.col("a.document_id") != F.col("document_id"), F.col("a")).otherwise(F.col("b"))
    return (
        joined.withColumn("other", other)
        .where(F.col("other.created_at") < F.col("created_at"))
        .withColumn("other_id", F.col("other.document_id"))
        .drop("supplier_key", "number_key", "a", "b", "other")
    )


def unknown_suppliers(targets: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Targets whose supplier is not on their tenant's list.

    The record side is stripped and lower-cased, the list side only lower-cased.
    No broadcast is forced: the list grows with the tenants, and Spark itself
    broadcasts it while it is small.
    """
    known = suppliers.select("tenant_id", F.lower("name").alias("supplier_key"))
    return (
        targets.where(F.col("supplier") != "")
        .withColumn("supplier_key", fold(F.col("supplier")))
        .join(known, ["tenant_id", "supplier_key"], "left_anti")
        .drop("supplier_key")
    )


def cross_issues(
    targets: DataFrame, latest: DataFrame, suppliers: DataFrame
) -> DataFrame:
    """Both cross-document checks as issue rows per extraction.

    They are warnings, so no decision depends on them; keeping them apart from
    the record checks lets the decision itself run without these joins.
    """
    duplicate = duplicate_invoices(targets, latest).select(
        "extraction_id", "document_id", "tenant_id",
        issue(
            "duplicate_invoice_number", "warning", "invoice_number",
            F.concat(
                F.lit("Invoice number '"), F.col("invoice_number"), F.lit("' from supplier '"),
                F.col("supplier"), F.lit("' already exists on document "), F.col("other_id"),
            ),
        ).alias("i"),
    )
    unknown = unknown_suppliers(targets, suppliers).select(
        "extraction_id", "document_id", "tenant_id",
        issue(
            "unknown_supplier", "warning", "supplier",
            F.concat(
                F.lit("Supplier '"), F.col("supplier"),
                F.lit("' is not in the known-suppliers list for this tenant"),
            ),
        ).alias("i"),
    )
    return duplicate.unionByName(unknown).select(
        "extraction_id", "document_id", "tenant_id", "i.*"
    )

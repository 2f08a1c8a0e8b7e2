"""From uploads to stored documents, and from pages to split documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerproof import registry
from ledgerproof.config import DEFAULTS, Settings
from ledgerproof.operators.classify import (
    group_ranges,
    normalize_answers,
    page_groups,
    split_documents,
    split_pages,
)
from ledgerproof.operators.ingest import (
    content_hash,
    documents_from_uploads,
    mark_duplicates,
    new_uploads,
    storage_names,
    upload_gate,
)


def intake(
    uploads: DataFrame, documents: DataFrame, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """New document rows, and the refused uploads with their reasons."""
    return admit(gate(uploads, settings), documents)


def gate(
    uploads: DataFrame, settings: Settings = DEFAULTS, any_hash: str | None = None
) -> DataFrame:
    """The gate's verdict and the hash of each upload, without its bytes. `file_hash` is that of
    accepted uploads; `any_hash` names a column for the hash of all."""
    hashed = content_hash(upload_gate(uploads, settings))
    if any_hash is not None:
        hashed = hashed.withColumn(any_hash, F.col("file_hash"))
    return hashed.withColumn("file_hash", F.when(F.col("accepted"), F.col("file_hash"))).drop("content")


def admit(gated: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New document rows, and the refused uploads with their reasons, from gated uploads."""
    refused = gated.where(~F.col("accepted")).select("upload_id", "tenant_id", "reasons")
    passed = gated.where("accepted")
    first = mark_duplicates(new_uploads(passed, documents)).where(~F.col("duplicate"))
    return documents_from_uploads(storage_names(first)), refused


def split(
    documents: DataFrame, pages: DataFrame, answers: DataFrame, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """Documents and pages after splitting by page type."""
    grouped = page_groups(normalize_answers(pages, answers, registry.names(), settings))
    return (
        split_documents(documents, group_ranges(grouped), registry.names()),
        split_pages(pages, grouped),
    )

"""The document flow as stages of a chain: parse, classify, extract, validate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerproof import registry
from ledgerproof.config import DEFAULTS, Settings
from ledgerproof.operators.classify import (
    extract_work,
    group_ranges,
    page_groups,
    split_documents,
    split_pages,
)
from ledgerproof.operators.pages import document_text, own_pages, route_text
from ledgerproof.operators.safety import rejected_documents, safe_pages
from ledgerproof.plans.infer import Model, call_classifier, two_pass
from ledgerproof.plans.trust import CANDIDATE, trust_flow
from ledgerproof.session import materialise
from ledgerproof.streaming.chain import Stage, Tables, batch_table, written_before

IDENTITY = ("tenant_id", "file_hash", "filename", "mime_type", "storage_key", "created_at")


def parse(tables: Tables, settings: Settings = DEFAULTS) -> Tables:
    """From page candidates with the identity of their document: safe pages, and rejections.

    `input` has `document_id, page_no`, the columns of `route_text` and of a document's identity.
    """
    rows = materialise(route_text(tables["input"], settings), "parsed")
    pages = rows.drop(*IDENTITY)
    rejected = rejected_documents(pages, settings)
    documents = rows.select("document_id", *IDENTITY).dropDuplicates(["document_id"]).join(
        rejected.select("document_id"), "document_id", "left_anti"
    )
    return {"pages": safe_pages(pages), "rejected": rejected, "documents": documents}


def classify(
    tables: Tables, classifier: Model, settings: Settings = DEFAULTS, answers: str | None = None
) -> Tables:
    """Documents and pages split by page type; those of a registered type go on."""
    pages = tables["pages"]
    typed, costs = call_classifier(pages, classifier, settings, answers)
    grouped = materialise(page_groups(typed), "grouped")
    split = split_documents(
        tables["documents"].withColumnRenamed("document_id", "id"), group_ranges(grouped),
        registry.names(),
    )
    split = materialise(split, "split")
    return {
        "split": split, "pages": split_pages(pages, grouped), "classify_costs": costs,
        "documents": extract_work(split, registry.names()).select("document_id").join(
            split.select(F.col("id").alias("document_id"), "tenant_id"), "document_id"
        ),
    }


def extract(
    tables: Tables, cheap: Model, strong: Model, reviewer: Model | None = None,
    settings: Settings = DEFAULTS, answers: str | None = None,
) -> Tables:
    """The answers of both attempts to the documents that go on."""
    own = own_pages(tables["split"], tables["pages"])
    requests = document_text(own).join(tables["documents"], "document_id").select(
        "document_id", "tenant_id", "document_text"
    )
    found = two_pass(requests, own, cheap, strong, settings, reviewer, answers)
    return {"answers": found, "documents": tables["documents"]}


def validate(
    tables: Tables, suppliers: DataFrame, settings: Settings = DEFAULTS,
    earlier: DataFrame | None = None,
) -> Tables:
    """The decision on each document, and what the duplicate check of later batches reads of it.

    Duplicates are looked for in this batch and among the `earlier` documents, as they are when the
    stage runs; a document of a later batch changes no earlier decision.
    """
    own = own_pages(tables["split"], tables["pages"])
    written: Tables = {}

    def keep(rows: DataFrame, name: str) -> DataFrame:
        written[name] = materialise(rows, name)
        return written[name]

    outcomes = trust_flow(tables["answers"], own, suppliers, settings, keep, earlier=earlier)
    return {"outcomes": outcomes, "targets": written["decided"].select(*CANDIDATE)}


def document_stages(
    classifier: Model, cheap: Model, strong: Model, suppliers: DataFrame, answers: str | None = None,
    reviewer: Model | None = None, settings: Settings = DEFAULTS, root: str | None = None,
) -> list[Stage]:
    """The four stages. With `answers`, a folder, the model calls can be resumed within a batch; with
    `root`, the chain's folder, duplicates of documents in its earlier batches are found."""
    def decided(tables: Tables) -> Tables:
        earlier = None
        if root is not None and written_before(suppliers.sparkSession, root, "validate"):
            earlier = batch_table(suppliers.sparkSession, root, "validate", "targets")
        return validate(tables, suppliers, settings, earlier)

    return [
        Stage("parse", lambda t: parse(t, settings)),
        Stage("classify", lambda t: classify(t, classifier, settings, answers)),
        Stage("extract", lambda t: extract(t, cheap, strong, reviewer, settings, answers)),
        Stage("validate", decided),
    ]

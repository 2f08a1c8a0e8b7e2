"""Page classification answers, runs of equal pages, and document splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerproof.config import DEFAULTS, Settings
from ledgerproof.functions.text import fold
from ledgerproof.operators.skew import run_index

# The types that operators know when they are not told; plans pass the registry's.
REGISTERED = ("invoice",)


def normalize_answers(
    pages: DataFrame, answers: DataFrame, registered: tuple[str, ...] = REGISTERED,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """One row per page and answer: `document_id, page_no, answer_no, doc_type, confidence`.

    Answers for pages that do not exist vanish, pages without an answer become
    (`unknown`, 0.0), and a type that is unregistered or not confident enough
    becomes `unknown` with its confidence kept. A page answered twice stays
    twice, in `answer_no` order.
    """
    keys = ["document_id", "page_no"]
    kind = fold(F.when(F.col("doc_type") != "", F.col("doc_type")).otherwise(F.lit("unknown")))
    confidence = F.coalesce(F.col("confidence"), F.lit(0.0))
    trusted = kind.isin(*registered) & (confidence >= settings.classify_threshold)
    cleaned = answers.select(
        *keys, "answer_no",
        F.when(trusted, kind).otherwise(F.lit("unknown")).alias("doc_type"),
        confidence.alias("confidence"),
    )
    return pages.select(*keys).join(cleaned, keys, "left").select(
        *keys,
        F.coalesce("answer_no", F.lit(0)).alias("answer_no"),
        F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def page_groups(classified: DataFrame, width: int = 4096) -> DataFrame:
    """Add `group_no`: runs of equal type in page order, from 0 per document."""
    return run_index(
        classified, "document_id", ["page_no", "answer_no"], "doc_type", "group_no", width
    )


def group_ranges(grouped: DataFrame) -> DataFrame:
    """One row per page group with its type and page range."""
    return grouped.groupBy("document_id", "group_no").agg(
        F.min("doc_type").alias("doc_type"),
        F.min("page_no").alias("page_start"),
        F.max("page_no").alias("page_end"),
        F.count("*").alias("n_pages"),
    )


def child_id(document_id, group_no):
    """Stable id of a split-off document."""
    return F.sha2(F.concat(document_id, F.lit(":split"), group_no), 256)


def split_documents(
    documents: DataFrame, ranges: DataFrame, registered: tuple[str, ...] = REGISTERED
) -> DataFrame:
    """Parents narrowed to group 0 plus one child document per further group.

    A parent keeps a null range when all its pages form one group.
    """
    group = F.struct("doc_type", "page_start", "page_end")
    parents = (
        ranges.groupBy(F.col("document_id").alias("id"))
        .agg(F.min_by(group, "group_no").alias("g"), F.max("group_no").alias("last_group"))
        .select(
            "id", F.lit(0).alias("group_no"), "g.doc_type",
            F.when(F.col("last_group") > 0, F.col("g.page_start")).alias("page_start"),
            F.when(F.col("last_group") > 0, F.col("g.page_end")).alias("page_end"),
        )
    )
    children = ranges.where("group_no > 0").select(
        F.col("document_id").alias("id"), "group_no", "doc_type", "page_start", "page_end"
    )
    joined = documents.select(
        "id", "tenant_id", "file_hash", "filename", "mime_type", "storage_key", "created_at"
    ).join(parents.unionByName(children), "id")
    is_child = F.col("group_no") > 0
    status = F.when(F.col("doc_type").isin(*registered), "classified").otherwise("needs_review")
    suffix = F.concat(F.lit(":split"), F.col("group_no"))
    label = F.concat(
        F.lit(" [pages "), F.col("page_start"), F.lit("-"), F.col("page_end"), F.lit("]")
    )

    def named(child, parent):
        return F.when(is_child, child).otherwise(F.col(parent)).alias(parent)

    return joined.select(
        named(child_id(F.col("id"), F.col("group_no")), "id"),
        "tenant_id",
        named(F.concat("file_hash", suffix), "file_hash"),
        named(F.concat("filename", label), "filename"),
        "mime_type", "storage_key", "doc_type",
        status.alias("status"),
        F.when(is_child, F.col("id")).alias("split_from_document_id"),
        "page_start", "page_end", "created_at",
    )


def split_pages(pages: DataFrame, grouped: DataFrame) -> DataFrame:
    """All parent pages, plus a copy of each child's pages under its own id.

    The group number already sits on every page, so copying needs no range
    join. Page numbers stay those of the upload.
    """
    children = grouped.where("group_no > 0").select("document_id", "page_no", "group_no").distinct()
    copies = pages.join(children, ["document_id", "page_no"]).withColumn(
        "document_id", child_id(F.col("document_id"), F.col("group_no"))
    ).drop("group_no")
    return pages.unionByName(copies)


def extract_work(
    split: DataFrame, registered: tuple[str, ...] = REGISTERED
) -> DataFrame:
    """The extract jobs to queue: documents of a registered type."""
    return split.where(F.col("doc_type").isin(*registered)).select(
        F.col("id").alias("document_id"), F.lit("extract").alias("stage"),
        F.lit("queued").alias("status"),
    )


def split_children(documents: DataFrame) -> DataFrame:
    """(document_id, child_document_id) pairs."""
    return documents.where(F.col("split_from_document_id").isNotNull()).select(
        F.col("split_from_document_id").alias("document_id"), F.col("id").alias("child_document_id")
    )

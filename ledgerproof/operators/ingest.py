"""Upload gate, content identity, storage names and small table upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerproof.config import DEFAULTS, EXTENSIONS, SIGNATURES, STRUCTURE_DENYLIST, Settings


def sniff_mime(content: Column) -> Column:
    """File kind by its leading bytes; `unknown` for everything else."""
    found = F.lit("unknown")
    for mime, prefix in reversed(SIGNATURES.items()):
        head = F.hex(F.substring(content, 1, len(prefix) // 2))
        found = F.when(head == prefix, F.lit(mime)).otherwise(found)
    return found


def structure_hits(content: Column) -> Column:
    """Messages for every denied name among the bytes, in list order."""
    checks = [
        F.when(
            F.contains(content, F.lit(name.encode())),
            F.lit(f"PDF contains disallowed object '{name}'"),
        )
        for name in STRUCTURE_DENYLIST
    ]
    return F.array_compact(F.array(*checks))


def gate_reasons(
    content: Column, open_error: Column, is_encrypted: Column, page_count: Column,
    settings: Settings = DEFAULTS,
) -> Column:
    """Ordered reasons to refuse an upload; empty when it may pass.

    A kind that is not allowed ends the list, and so does a file that cannot be
    opened; page facts only apply to PDFs.
    """
    size = F.octet_length(content)
    mime = sniff_mime(content)
    too_big = F.when(
        size > settings.max_upload_bytes,
        F.lit(f"file exceeds the {settings.max_upload_bytes // (1024 * 1024)}MB size limit"),
    )
    allowed = mime.isin(*settings.allowed_mime_types)
    wrong_kind = F.concat(F.lit("file content type '"), mime, F.lit("' is not allowed"))
    is_pdf = mime == "application/pdf"
    broken = is_pdf & open_error.isNotNull()
    unopened = F.concat(F.lit("file could not be opened as a valid PDF: "), open_error)
    page_fact = F.when(
        is_pdf & F.coalesce(is_encrypted, F.lit(False)),
        F.lit("PDF is encrypted/password-protected"),
    ).when(
        is_pdf & (page_count > settings.max_pages),
        F.format_string(
            f"PDF has %d pages, exceeding the limit of {settings.max_pages}", page_count
        ),
    )
    refused = F.when(F.coalesce(size == 0, F.lit(True)), F.array(F.lit("empty file")))
    return (
        refused.when(~allowed, F.array_compact(F.array(too_big, wrong_kind)))
        .when(broken, F.array_compact(F.array(too_big, unopened)))
        .otherwise(
            F.concat(F.array_compact(F.array(too_big, page_fact)), structure_hits(content))
        )
    )


def upload_gate(uploads: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add `mime_type`, `reasons` and `accepted` to every upload."""
    return uploads.withColumn("mime_type", sniff_mime(F.col("content"))).withColumn(
        "reasons",
        gate_reasons(
            F.col("content"), F.col("open_error"), F.col("is_encrypted"), F.col("page_count"),
            settings,
        ),
    ).withColumn("accepted", F.size("reasons") == 0)


def content_hash(uploads: DataFrame) -> DataFrame:
    return uploads.withColumn("file_hash", F.sha2("content", 256))


def mark_duplicates(uploads: DataFrame) -> DataFrame:
    """Give every upload the id of the first one with its tenant and bytes.

    The first upload per (tenant_id, file_hash) wins; its id is `document_id`
    for all copies and `duplicate` is true on the later ones. The first is
    found by a plain aggregate (combined before the shuffle) with one row per
    key, so Spark splits heavily copied content when it is joined back.
    """
    keys = ["tenant_id", "file_hash"]
    winners = uploads.groupBy(*keys).agg(
        F.min_by("upload_id", F.struct("created_at", "upload_id")).alias("document_id")
    )
    return uploads.join(winners, keys).withColumn(
        "duplicate", F.col("upload_id") != F.col("document_id")
    )


def new_uploads(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """Uploads whose tenant and bytes are not in the documents table yet."""
    known = documents.select("tenant_id", "file_hash")
    return uploads.join(known, ["tenant_id", "file_hash"], "left_anti")


def storage_names(uploads: DataFrame) -> DataFrame:
    """Add `extension`, `storage_key` and a default `filename`."""
    by_mime = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    ext = F.coalesce(F.try_element_at(by_mime, F.col("mime_type")), F.lit("bin"))
    return (
        uploads.withColumn("extension", ext)
        .withColumn(
            "storage_key",
            F.concat("tenant_id", F.lit("/"), "file_hash", F.lit("."), "extension"),
        )
        .withColumn(
            "filename",
            F.when(F.col("filename") != "", F.col("filename")).otherwise(
                F.concat(F.lit("upload."), F.col("extension"))
            ),
        )
    )


def documents_from_uploads(accepted: DataFrame) -> DataFrame:
    """New document rows for first uploads, status `uploaded`."""
    null = F.lit(None)
    return accepted.select(
        F.col("document_id").alias("id"), "tenant_id", "file_hash", "filename", "mime_type",
        "storage_key", null.cast("string").alias("doc_type"), F.lit("uploaded").alias("status"),
        null.cast("double").alias("confidence"),
        null.cast("string").alias("split_from_document_id"),
        null.cast("int").alias("page_start"), null.cast("int").alias("page_end"),
        "created_at", F.col("created_at").alias("updated_at"),
    )


def supplier_upsert(suppliers: DataFrame, names: DataFrame) -> DataFrame:
    """Append the (tenant_id, name) pairs that are not present by exact name."""
    keys = ["tenant_id", "name"]
    fresh = names.select(*keys).distinct().join(suppliers.select(*keys), keys, "left_anti")
    return suppliers.select(*keys).unionByName(fresh)


def prefix_replace(
    documents: DataFrame, replacement: DataFrame, tenant_id: str, prefix: str
) -> DataFrame:
    """Drop a tenant's rows whose hash starts with `prefix`, add the new ones."""
    stale = (F.col("tenant_id") == tenant_id) & F.col("file_hash").startswith(prefix)
    return documents.where(~F.coalesce(stale, F.lit(False))).unionByName(replacement)


def approved_outbox(documents: DataFrame, data: DataFrame, enabled: bool = True) -> DataFrame:
    """One JSON event per approved document.

    `data` has `document_id` and a struct `data`. With `enabled=False` (no
    receiver configured) no event is produced.
    """
    approved = documents.where((F.col("status") == "approved") & F.lit(enabled))
    joined = approved.join(
        data.withColumnRenamed("document_id", "id"), "id", "left"
    )
    return joined.select(
        F.col("id").alias("document_id"),
        F.to_json(
            F.struct(
                F.lit("document.approved").alias("event"),
                F.col("id").alias("document_id"),
                "tenant_id", "doc_type", "confidence", "data",
            ),
            {"ignoreNullFields": "false"},
        ).alias("payload"),
    )

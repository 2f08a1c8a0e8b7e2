"""Upload, safety and small-table queries over `documents` and `conversations`."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ledgerproof.catalog import base as b
from ledgerproof.catalog.core import joined, query
from ledgerproof.config import DEFAULTS, STRUCTURE_DENYLIST
from ledgerproof.operators import ingest, safety

# A lower size limit, so that the given texts fall on both sides of it.
SMALL = replace(DEFAULTS, max_upload_bytes=8192)


def uploads(t):
    """Every document text as an uploaded file of one of four kinds."""
    k = F.col("doc_id")
    head = (
        F.when(k % 6 == 3, F.unhex(F.lit("89504E470D0A1A0A")))
        .when(k % 6 == 4, F.unhex(F.lit("FFD8FF")))
        .when(k % 6 == 5, F.unhex(F.lit("")))
        .otherwise(F.lit("%PDF-1.4\n").cast("binary"))
    )
    tail = (
        F.when(k % 9 == 4, "\n/JavaScript /JS (x)").when(k % 9 == 5, " /AA ").otherwise("")
    )
    return t.documents.select(
        "doc_id",
        F.concat(F.lit("U"), F.lpad(k.cast("string"), 12, "0")).alias("upload_id"),
        F.col("lang").alias("tenant_id"),
        F.when(k % 4 == 1, "").otherwise(F.concat(F.lit("f"), k)).alias("filename"),
        F.concat(head, F.encode(F.concat("text", tail), "UTF-8")).alias("content"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).alias("created_at"),
        F.when(k % 14 == 3, "broken xref").alias("open_error"),
        (k % 16 == 5).alias("is_encrypted"),
        (F.floor(F.col("n_chars") / 500) + 1).cast("int").alias("page_count"),
    )


UPLOADS_SQL = """
WITH up AS (
  SELECT *, text || CASE WHEN doc_id % 9 = 4 THEN chr(10) || '/JavaScript /JS (x)'
                         WHEN doc_id % 9 = 5 THEN ' /AA ' ELSE '' END AS body,
    'U' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS upload_id, lang AS tenant_id,
    CASE doc_id % 6 WHEN 3 THEN 8 WHEN 4 THEN 3 WHEN 5 THEN 0 ELSE 9 END AS head,
    CASE doc_id % 6 WHEN 3 THEN 'image/png' WHEN 4 THEN 'image/jpeg' WHEN 5 THEN 'unknown'
      ELSE 'application/pdf' END AS mime_type,
    CAST(floor(n_chars / 500) + 1 AS INTEGER) AS page_count
  FROM documents),
sized AS (SELECT *, octet_length(encode(body)) + head AS size FROM up)
"""
HITS_SQL = ", ".join(
    f"CASE WHEN contains(body, '{p}') THEN 'PDF contains disallowed object ''{p}''' END"
    for p in STRUCTURE_DENYLIST
)


@query("upload_gate", UPLOADS_SQL + f""",
parts AS (
  SELECT *, CASE WHEN size > 8192 THEN 'file exceeds the 0MB size limit' END AS too_big,
    CASE WHEN mime_type = 'application/pdf' AND doc_id % 16 = 5 THEN 'PDF is encrypted/password-protected'
         WHEN mime_type = 'application/pdf' AND page_count > 25 THEN
           'PDF has ' || page_count || ' pages, exceeding the limit of 25' END AS page_fact
  FROM sized),
done AS (
  SELECT upload_id, tenant_id, mime_type, CASE WHEN size = 0 THEN 'empty file'
    WHEN mime_type = 'unknown' THEN concat_ws('|', too_big, 'file content type ''unknown'' is not allowed')
    WHEN mime_type = 'application/pdf' AND doc_id % 14 = 3
      THEN concat_ws('|', too_big, 'file could not be opened as a valid PDF: broken xref')
    ELSE concat_ws('|', too_big, page_fact, {HITS_SQL}) END AS reasons
  FROM parts)
SELECT *, reasons = '' AS accepted FROM done""")
def upload_gate(t):
    return ingest.upload_gate(uploads(t), SMALL).select(
        "upload_id", "tenant_id", "mime_type", joined(F.col("reasons")).alias("reasons"), "accepted"
    )


@query("structure_scan", UPLOADS_SQL + f"""
SELECT upload_id, concat_ws('|', {HITS_SQL}) AS hits FROM sized""")
def structure_scan(t):
    return uploads(t).select(
        "upload_id", joined(ingest.structure_hits(F.col("content"))).alias("hits")
    )


@query("mime_sniff", UPLOADS_SQL + """
SELECT mime_type, count(*) AS n_files FROM sized GROUP BY mime_type""")
def mime_sniff(t):
    return uploads(t).groupBy(ingest.sniff_mime(F.col("content")).alias("mime_type")).agg(
        F.count("*").alias("n_files")
    )


def _texts(t):
    """Each document text as uploaded bytes; many are exact copies."""
    k = F.col("doc_id")
    return t.documents.select(
        F.concat(F.lit("U"), F.lpad(k.cast("string"), 12, "0")).alias("upload_id"),
        F.col("lang").alias("tenant_id"),
        F.encode("text", "UTF-8").alias("content"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).alias("created_at"),
    )


HASHED_SQL = """
WITH up AS (
  SELECT 'U' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS upload_id, lang AS tenant_id,
    sha256(text) AS file_hash, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS created_at
  FROM documents)
"""


@query("content_hash", HASHED_SQL + "SELECT upload_id, file_hash FROM up")
def content_hash(t):
    return ingest.content_hash(_texts(t)).select("upload_id", "file_hash")


@query("idempotent_upload", HASHED_SQL + """
SELECT upload_id, tenant_id,
  first_value(upload_id) OVER w AS document_id,
  upload_id <> first_value(upload_id) OVER w AS duplicate
FROM up WINDOW w AS (PARTITION BY tenant_id, file_hash ORDER BY created_at, upload_id)""")
def idempotent_upload(t):
    hashed = ingest.content_hash(_texts(t)).drop("content")
    return ingest.mark_duplicates(hashed).select(
        "upload_id", "tenant_id", "document_id", "duplicate"
    )


@query("new_uploads", HASHED_SQL + """
SELECT upload_id, tenant_id FROM up WHERE NOT EXISTS (
  SELECT 1 FROM up AS o JOIN labels ON o.upload_id = 'U' || lpad(CAST(labels.doc_id AS VARCHAR), 12, '0')
  WHERE o.tenant_id = up.tenant_id AND o.file_hash = up.file_hash)""")
def new_uploads(t):
    hashed = ingest.content_hash(_texts(t)).drop("content")
    stored = t.labels.select(
        F.concat(F.lit("U"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("upload_id")
    )
    documents = hashed.join(stored, "upload_id", "left_semi")
    return ingest.new_uploads(hashed, documents).select("upload_id", "tenant_id")


@query("storage_key", UPLOADS_SQL + """
SELECT upload_id,
  tenant_id || '/' || sha256(text) || '.' || CASE doc_id % 6 WHEN 3 THEN 'png' WHEN 4 THEN 'jpg'
    WHEN 5 THEN 'bin' ELSE 'pdf' END AS storage_key,
  CASE WHEN doc_id % 4 = 1 THEN 'upload.' || CASE doc_id % 6 WHEN 3 THEN 'png' WHEN 4 THEN 'jpg'
    WHEN 5 THEN 'bin' ELSE 'pdf' END ELSE 'f' || doc_id END AS filename
FROM up""")
def storage_key(t):
    kinds = uploads(t).withColumn("mime_type", ingest.sniff_mime(F.col("content")))
    hashes = ingest.content_hash(_texts(t)).select("upload_id", "file_hash")
    named = ingest.storage_names(kinds.drop("content").join(hashes, "upload_id"))
    return named.select("upload_id", "storage_key", "filename")


@query("supplier_upsert", "WITH " + b.SUPPLIERS_SQL + """
SELECT tenant_id, name FROM known
UNION ALL
SELECT 't0', name FROM (SELECT DISTINCT s_name AS name FROM supplier) AS s
WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.tenant_id = 't0' AND known.name = s.name)""")
def supplier_upsert(t):
    asked = t.supplier.select(F.lit("t0").alias("tenant_id"), F.col("s_name").alias("name"))
    return ingest.supplier_upsert(b.suppliers(t), asked.unionByName(asked))


@query("prefix_replace", """
SELECT lang AS tenant_id, sha256(text) AS file_hash, 'U' || doc_id AS id FROM documents
WHERE NOT (lang = 'en' AND starts_with(sha256(text), 'a'))
UNION ALL SELECT 'en', 'a' || sha256(text), 'B' || item_id FROM benchmark""")
def prefix_replace(t):
    documents = t.documents.select(
        F.col("lang").alias("tenant_id"), F.sha2("text", 256).alias("file_hash"),
        F.concat(F.lit("U"), "doc_id").alias("id"),
    )
    fresh = t.benchmark.select(
        F.lit("en").alias("tenant_id"),
        F.concat(F.lit("a"), F.sha2("text", 256)).alias("file_hash"),
        F.concat(F.lit("B"), "item_id").alias("id"),
    )
    return ingest.prefix_replace(documents, fresh, "en", "a")


# --- text safety -----------------------------------------------------------

def _quote(s):
    return "'" + s.replace("'", "''") + "'"


def pages(t):
    """All document texts and conversation turns as pages; some carry a phrase."""
    docs = t.documents.select(
        F.concat(F.lit("T"), "doc_id").alias("document_id"), F.lit(1).alias("page_no"), "text",
        F.col("doc_id").alias("n"),
    )
    turns = t.conversations.select(
        F.concat(F.lit("C"), "conv_id").alias("document_id"),
        (F.col("turn") + 1).cast("int").alias("page_no"), "text",
        (F.col("conv_id") * 7 + F.col("turn")).alias("n"),
    )
    phrases = F.array(*[F.lit(p) for p in safety.PHRASES])
    pick = F.element_at(phrases, (F.col("n") % len(safety.PHRASES) + 1).cast("int"))
    spliced = F.when(
        F.col("n") % 17 == 0, F.concat("text", F.lit(" "), F.upper(pick), F.lit(" and more"))
    ).otherwise(F.col("text"))
    return docs.unionByName(turns).select("document_id", "page_no", spliced.alias("text"))


PAGES_SQL = f"""
WITH raw AS (
  SELECT 'T' || doc_id AS document_id, 1 AS page_no, text, doc_id AS n FROM documents
  UNION ALL
  SELECT 'C' || conv_id, CAST(turn + 1 AS INTEGER), text, conv_id * 7 + turn FROM conversations),
pg AS (
  SELECT document_id, page_no, CASE WHEN n % 17 = 0 THEN
    text || ' ' || upper([{', '.join(_quote(p) for p in safety.PHRASES)}][n % {len(safety.PHRASES)} + 1])
    || ' and more' ELSE text END AS text
  FROM raw)
"""


@query("text_safety_scan", PAGES_SQL + "SELECT document_id, page_no, concat_ws('|', " + ", ".join(
    f"CASE WHEN contains(lower(text), {_quote(p)}) THEN {_quote(m)} END"
    for p, m in zip(safety.PHRASES, safety.MESSAGES)) + ") AS hits FROM pg")
def text_safety_scan(t):
    return safety.scan_pages(pages(t)).select(
        "document_id", "page_no", joined(safety.hit_messages(F.col("mask"))).alias("hits")
    )


@query("rejected_documents", PAGES_SQL + ", hit AS (SELECT document_id, concat_ws('; ', " + ", ".join(
    f"CASE WHEN max(CASE WHEN contains(lower(text), {_quote(p)}) THEN 1 ELSE 0 END) = 1 THEN {_quote(m)} END"
    for p, m in zip(safety.PHRASES, safety.MESSAGES)) + """) AS hits FROM pg GROUP BY document_id)
SELECT document_id, 'rejected' AS status, left('blocked by security scan: ' || hits, 2000) AS last_error
FROM hit WHERE hits <> ''""")
def rejected_documents(t):
    return safety.rejected_documents(pages(t))


@query("safe_pages", PAGES_SQL + """, bad AS (SELECT DISTINCT document_id FROM pg WHERE """
       + " OR ".join(f"contains(lower(text), {_quote(p)})" for p in safety.PHRASES) + """)
SELECT document_id, page_no FROM pg WHERE document_id NOT IN (SELECT document_id FROM bad)""")
def safe_pages(t):
    return safety.safe_pages(pages(t)).select("document_id", "page_no")


@query("safety_hits_by_phrase", PAGES_SQL + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {_quote(p)} AS phrase, count(*) AS n_pages FROM pg WHERE contains(lower(text), {_quote(p)})"
    for p in safety.PHRASES) + ") AS u WHERE n_pages > 0")
def safety_hits_by_phrase(t):
    return safety.hits_by_phrase(pages(t))

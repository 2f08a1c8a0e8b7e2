"""Table schemas as DDL strings; `spark.createDataFrame` and readers take them."""

from __future__ import annotations

WORD = "struct<text:string,bbox:array<double>>"
LINE_ITEM = "struct<description:string,quantity:double,unit_price:double,amount:double>"
ISSUE = "struct<rule:string,severity:string,field:string,message:string>"
HINT = "struct<field:string,page_no:int,source_text:string>"
MATCH = "struct<field:string,page_no:int,bbox:array<double>,source_text:string>"

UPLOADS = (
    "upload_id string, tenant_id string, filename string, content binary, created_at timestamp, "
    "open_error string, is_encrypted boolean, page_count int"
)
DOCUMENTS = (
    "id string, tenant_id string, file_hash string, filename string, mime_type string, storage_key string, "
    "doc_type string, status string, confidence double, split_from_document_id string, "
    "page_start int, page_end int, created_at timestamp, updated_at timestamp"
)
PAGES = (
    "document_id string, page_no int, text_source string, text string, image_key string, "
    f"words array<{WORD}>, created_at timestamp"
)
JOBS = (
    "id string, document_id string, stage string, status string, attempts int, locked_at timestamp, "
    "next_run_at timestamp, last_error string, created_at timestamp, updated_at timestamp"
)
EXTRACTIONS = (
    "extraction_id string, document_id string, tenant_id string, model string, attempt_no int, raw string, "
    "tokens struct<input:bigint,output:bigint>, cost_usd double, latency_ms int, created_at timestamp"
)
FIELD_VALUES = (
    "extraction_id string, field string, value string, page_no int, bbox array<double>, "
    "source_text string, confidence double"
)
ISSUES = "extraction_id string, field string, rule string, severity string, message string"
SUPPLIERS = "tenant_id string, name string"
CORRECTIONS = (
    "document_id string, field string, seq bigint, new_value string, reviewer string"
)

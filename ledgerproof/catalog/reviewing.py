"""Read queries and human review over order-shaped documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerproof.catalog import base as b
from ledgerproof.catalog import joblog
from ledgerproof.catalog.checks import RULE_NAMES_SQL as RULES_TEXT
from ledgerproof.catalog.core import joined, query
from ledgerproof.catalog.records import LONG_SQL, long_rows
from ledgerproof.config import NUMBER_FIELDS, TERMINAL_STATUSES
from ledgerproof.operators import evaluate, ground, ingest, record, review
from ledgerproof.operators.rules import issue_rows, validate_records
from ledgerproof.session import materialise


def documents(t):
    """Every order as a stored document in some state."""
    status = (
        F.when(F.col("o_orderstatus") == "F", "approved")
        .when(F.col("o_orderstatus") == "O", "needs_review")
        .when(F.col("o_orderpriority") == "1-URGENT", "failed")
        .when(F.col("o_orderpriority") == "2-HIGH", "rejected")
        .otherwise("extracted")
    )
    k = F.col("o_orderkey")
    confidence = (
        F.when(F.col("o_orderstatus") == "F", F.when(k % 3 == 0, 1.0).otherwise(0.75))
        .when(F.col("o_orderstatus") == "O", k % 3 / 4.0)
    )
    return t.orders.select(
        F.concat(F.lit("D"), F.lpad(k.cast("string"), 12, "0")).alias("id"),
        F.concat(F.lit("t"), F.col("o_custkey") % 5).alias("tenant_id"),
        F.concat(F.lit("inv-"), k, F.lit(".pdf")).alias("filename"),
        F.lit("invoice").alias("doc_type"),
        status.alias("status"), confidence.alias("confidence"),
        F.col("o_orderdate").alias("created_at"),
        F.when(k % 50 == 0, F.concat(F.lit("D"), F.lpad((k + 1).cast("string"), 12, "0")))
        .alias("split_from_document_id"),
        F.when(k % 50 == 0, 2).alias("page_start"),
    )


DOCS_SQL = """
docs AS (
  SELECT o_orderkey AS k, 'D' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS document_id,
    't' || CAST(o_custkey % 5 AS VARCHAR) AS tenant_id, 'inv-' || o_orderkey || '.pdf' AS filename,
    'invoice' AS doc_type,
    CASE WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderstatus = 'O' THEN 'needs_review'
         WHEN o_orderpriority = '1-URGENT' THEN 'failed' WHEN o_orderpriority = '2-HIGH' THEN 'rejected'
         ELSE 'extracted' END AS status,
    CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 1e0 ELSE 0.75e0 END
         WHEN o_orderstatus = 'O' THEN (o_orderkey % 3) / 4e0 END AS confidence,
    CAST(o_orderdate AS DATE) AS created_at,
    CASE WHEN o_orderkey % 50 = 0 THEN 'D' || lpad(CAST(o_orderkey + 1 AS VARCHAR), 12, '0') END AS parent
  FROM orders)
"""


def _day(df):
    return df.withColumn("created_at", F.col("created_at").cast("date"))


@query("list_documents", "WITH " + DOCS_SQL + """
SELECT document_id, tenant_id, filename, doc_type, status, confidence, created_at FROM docs
ORDER BY created_at DESC, document_id LIMIT 200""")
def list_documents(t):
    return _day(review.list_documents(documents(t)))


@query("list_documents_filtered", "WITH " + DOCS_SQL + """
SELECT document_id, tenant_id, filename, doc_type, status, confidence, created_at FROM docs
WHERE tenant_id = 't1' AND status = 'approved' ORDER BY created_at DESC, document_id LIMIT 200""")
def list_documents_filtered(t):
    return _day(review.list_documents(documents(t), "t1", "approved"))


@query("review_queue", "WITH " + DOCS_SQL + """
SELECT document_id, tenant_id, filename, confidence, created_at FROM docs
WHERE status = 'needs_review' ORDER BY created_at, document_id""")
def review_queue(t):
    return _day(review.review_queue(documents(t)))


@query("status_counts", "WITH " + DOCS_SQL + f"""
SELECT status, count(*) AS n_documents,
  status IN ({', '.join(f"'{s}'" for s in TERMINAL_STATUSES)}) AS is_terminal FROM docs GROUP BY status""")
def status_counts(t):
    return review.status_counts(documents(t))


# --- corrections -----------------------------------------------------------

def field_values(t):
    """Field rows of the base records, one extraction per document."""
    rows = b.records(t).withColumn("matches", ground.no_matches())
    return record.field_values_long(rows).withColumn("confidence", F.lit(0.75))


def latest(t):
    return b.base(t).select(
        "document_id", F.concat("document_id", F.lit("-1")).alias("extraction_id")
    )


def corrections(t):
    """Corrections per document in order: a currency, a total twice, all line items (of every
    seventh document), a field that is not there."""
    def asked(seq, field, value):
        return F.struct(
            F.lit(field).alias("field"), F.lit(seq).cast("bigint").alias("seq"), value.alias("new_value")
        )

    rows = F.array_compact(F.array(
        asked(1, "currency", F.lit("USD")),
        asked(2, "total", F.lit("1.50")),
        asked(3, "total", F.col("sum_total").cast("string")),
        F.when(F.col("k") % 7 == 0, asked(4, "line_items", F.lit("[]"))),
        asked(5, "notes", F.lit("x")),
    ))
    return b.base(t).select(
        "document_id", F.concat(F.lit("r"), F.col("k") % 4).alias("reviewer"), F.inline(rows)
    )


def effective(t):
    return review.effective_corrections(corrections(t), latest(t), field_values(t))


AUDIT_SQL = "WITH " + b.BASE_SQL + """,
asked AS (
  SELECT document_id, k, 'currency' AS field, 1 AS seq, currency AS old_text, 'USD' AS new_text,
    CAST(NULL AS DOUBLE) AS old_number, CAST(NULL AS DOUBLE) AS new_number FROM base
  UNION ALL SELECT document_id, k, 'total', 2, NULL, NULL, total, 1.5e0 FROM base
  UNION ALL SELECT document_id, k, 'total', 3, NULL, NULL, 1.5e0, sum_total FROM base
  UNION ALL SELECT document_id, k, 'line_items', 4, CAST(n_items AS VARCHAR), '0', NULL, NULL FROM base
    WHERE k % 7 = 0),
audit AS (
  SELECT document_id, field, seq, old_text, new_text, old_number, new_number, 'r' || (k % 4) AS reviewer
  FROM asked WHERE old_text IS DISTINCT FROM new_text OR old_number IS DISTINCT FROM new_number)
"""


def _typed(df, *names):
    """A value as text or as a number; line items as how many there are."""
    number, items = F.col("field").isin(*NUMBER_FIELDS), F.col("field") == "line_items"
    for n in names:
        value = F.col(f"{n}_value")
        df = df.withColumn(
            f"{n}_text",
            F.when(items, F.json_array_length(value).cast("string")).when(~number, value),
        ).withColumn(f"{n}_number", F.when(number, value.try_cast("double")))
    return df


@query("correction_audit", AUDIT_SQL + "SELECT * FROM audit")
def correction_audit(t):
    return _typed(review.correction_audit(effective(t)), "old", "new").select(
        "document_id", "field", F.col("seq").cast("int").alias("seq"), "old_text", "new_text",
        "old_number", "new_number", "reviewer",
    )


@query("apply_corrections", AUDIT_SQL + """,
vals AS (
  SELECT document_id, 'supplier' AS field, supplier AS text_value, CAST(NULL AS DOUBLE) AS number_value FROM base
  UNION ALL SELECT document_id, 'invoice_number', invoice_number, NULL FROM base
  UNION ALL SELECT document_id, 'invoice_date', CAST(invoice_date AS VARCHAR), NULL FROM base
  UNION ALL SELECT document_id, 'due_date', CAST(due_date AS VARCHAR), NULL FROM base
  UNION ALL SELECT document_id, 'currency', currency, NULL FROM base
  UNION ALL SELECT document_id, 'subtotal', NULL, subtotal FROM base
  UNION ALL SELECT document_id, 'tax', NULL, tax FROM base
  UNION ALL SELECT document_id, 'total', NULL, total FROM base
  UNION ALL SELECT document_id, 'line_items', CAST(n_items AS VARCHAR), NULL FROM base),
last AS (
  SELECT document_id, field, max_by(new_text, seq) AS new_text, max_by(new_number, seq) AS new_number
  FROM audit GROUP BY document_id, field)
SELECT vals.document_id || '-1' AS extraction_id, vals.field,
  CASE WHEN last.field IS NULL THEN text_value ELSE new_text END AS text_value,
  CASE WHEN last.field IS NULL THEN number_value ELSE new_number END AS number_value,
  CASE WHEN last.field IS NULL THEN 0.75e0 ELSE 1e0 END AS confidence
FROM vals LEFT JOIN last ON last.document_id = vals.document_id AND last.field = vals.field""")
def apply_corrections(t):
    corrected = review.apply_corrections(field_values(t), effective(t))
    return _typed(corrected.withColumnRenamed("value", "new_value"), "new").select(
        "extraction_id", "field", F.col("new_text").alias("text_value"),
        F.col("new_number").alias("number_value"), "confidence",
    )


@query("correction_round", AUDIT_SQL + "," + DOCS_SQL + """
SELECT docs.document_id, 'document.approved' AS event, docs.tenant_id, 1e0 AS confidence,
  'USD' AS currency, sum_total AS total, CASE WHEN base.k % 7 = 0 THEN 0 ELSE n_items END AS n_items,
  base.invoice_number FROM docs JOIN base ON base.document_id = docs.document_id
WHERE docs.status = 'needs_review'""")
def correction_round(t):
    """Reviews of the documents that wait for one: their events, with the data as corrected."""
    docs = documents(t)
    waiting = docs.where(F.col("status") == "needs_review").select(F.col("id").alias("document_id"))
    asked = corrections(t).join(waiting, "document_id", "left_semi")
    _, _, _, events = review.submit_corrections(docs, asked, latest(t), field_values(t), waiting)

    def at(path):
        return F.get_json_object("payload", path)

    return events.select(
        "document_id", at("$.event").alias("event"), at("$.tenant_id").alias("tenant_id"),
        at("$.confidence").cast("double").alias("confidence"), at("$.data.currency").alias("currency"),
        at("$.data.total").cast("double").alias("total"),
        F.json_array_length(at("$.data.line_items")).alias("n_items"),
        at("$.data.invoice_number").alias("invoice_number"),
    )


@query("approve_corrected", "WITH " + DOCS_SQL + """,
has AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT document_id, CASE WHEN status = 'needs_review' AND has.k IS NOT NULL THEN 'approved' ELSE status END AS status,
  CASE WHEN status = 'needs_review' AND has.k IS NOT NULL THEN 1e0 ELSE confidence END AS confidence
FROM docs LEFT JOIN has ON has.k = docs.k""")
def approve_corrected(t):
    docs = documents(t)
    reviewed = docs.where(F.col("status") == "needs_review").select(F.col("id").alias("document_id"))
    return review.approve_corrected(docs, reviewed, latest(t)).select(
        F.col("id").alias("document_id"), "status", "confidence"
    )


# What is typed, and the text and number it means in a field that held a number.
TYPED = {
    "   ": (None, None), " about ": ("about", None), "1_000": ("1_000", None), "nan": ("nan", None),
    "inf": ("inf", None), "0x10": (None, 16.0), " 0b101": (None, 5.0), "0O17": (None, 15.0),
    "5.": (None, 5.0), ".5e1": (None, 5.0), "-3e2 ": (None, -300.0), "10d": ("10d", None),
    "1,000.00": ("1,000.00", None), "-0x10": ("-0x10", None), "Infinity": (None, None),
    "\ufeff7\u2003": (None, 7.0), "NaN": ("NaN", None), "+.": ("+.", None),
}


def _sql_text(x):
    return "NULL" if x is None else f"'{x}'"


@query("correction_typing", "SELECT event_id, e.text_value, e.number_value, CASE WHEN trim(e.entered) <> '' "
       "THEN e.plain END AS kept_text FROM events JOIN (VALUES " + ", ".join(
           f"({k}, {_sql_text(text)}, CAST({'NULL' if number is None else number} AS DOUBLE), "
           f"{_sql_text(entered)}, {_sql_text(entered.strip(chr(0xfeff) + chr(0x2003) + ' '))})"
           for k, (entered, (text, number)) in enumerate(TYPED.items()))
       + f") AS e(n, text_value, number_value, entered, plain) ON event_id % {len(TYPED)} = e.n")
def correction_typing(t):
    entered = F.element_at(
        F.array(*[F.lit(x) for x in TYPED]), (F.col("event_id") % len(TYPED) + 1).cast("int")
    )
    typed = review.type_correction(F.lit(True), entered)
    number = review.form_number(typed)
    return t.events.select(
        "event_id", F.when(number.isNull(), typed).alias("text_value"), number.alias("number_value"),
        review.type_correction(F.lit(False), entered).alias("kept_text"),
    )


def first_answers(t):
    """The field rows of first answers, grounded on their pages; written, as they are read twice."""
    return materialise(long_rows(t, F.col("extraction_id").endswith("-1")), "values")


@query("correction_examples", LONG_SQL + """,
asked AS (
  SELECT document_id, extraction_id, 'currency' AS field, 'USD' AS new_text, CAST(NULL AS DOUBLE) AS new_number
  FROM ans WHERE attempt_no = 1 AND currency IS DISTINCT FROM 'USD'
  UNION ALL SELECT document_id, extraction_id, 'total', NULL, 1.5e0 FROM ans
  WHERE attempt_no = 1 AND total IS DISTINCT FROM 1.5e0
  UNION ALL SELECT ans.document_id, extraction_id, 'total', NULL, base.sum_total
  FROM ans JOIN base ON base.document_id = ans.document_id
  WHERE attempt_no = 1 AND base.sum_total IS DISTINCT FROM 1.5e0)
SELECT asked.document_id, asked.field, new_text, new_number, 'cheap' AS model, 1 AS attempt_no,
  page_no, source_text FROM asked
LEFT JOIN found ON found.extraction_id = asked.extraction_id AND found.field = asked.field""")
def correction_examples(t):
    values = first_answers(t)
    asked = corrections(t).where(F.col("field").isin("currency", "total"))
    audit = review.correction_audit(review.effective_corrections(asked, latest(t), values))
    extractions = latest(t).select(
        "extraction_id", F.lit("cheap").alias("model"), F.lit(1).alias("attempt_no")
    )
    joined_rows = evaluate.correction_examples(audit, values, extractions)
    return _typed(joined_rows, "new").select(
        "document_id", "field", "new_text", "new_number", "model", "attempt_no", "page_no", "source_text"
    )


# --- detail ----------------------------------------------------------------

def _page_rows(t):
    return b.pages(t).select("document_id", "page_no", "text_source", F.concat(
        "document_id", F.lit("_page"), "page_no", F.lit(".png")).alias("image_key"))


@query("document_detail", "WITH " + b.BASE_SQL + "," + DOCS_SQL + "," + joblog.JOBS_SQL + """,
kids AS (SELECT parent AS document_id, string_agg(document_id, '|' ORDER BY document_id) AS children
  FROM docs WHERE parent IS NOT NULL GROUP BY parent),
shown AS (
  SELECT document_id, """ + f"""{RULES_TEXT} AS issues FROM base)
SELECT docs.document_id, docs.tenant_id, docs.filename, docs.doc_type, docs.status, docs.confidence, parent,
  coalesce(kids.children, '') AS children,
  CASE WHEN base.k IS NOT NULL THEN '1:text_layer|2:text_layer' END AS pages,
  CASE WHEN base.k IS NOT NULL THEN 9 END AS n_fields, base.total, base.currency, base.n_items,
  CASE WHEN base.k IS NOT NULL THEN docs.document_id || '-1' END AS extraction_id,
  CASE WHEN base.k IS NOT NULL THEN 'cheap' END AS model, CASE WHEN base.k IS NOT NULL THEN 1 END AS attempt_no,
  CASE WHEN base.k IS NOT NULL THEN base.k % 100 + 500 END AS input_tokens,
  CASE WHEN base.k IS NOT NULL THEN (base.k % 100 + 500) / 1000000e0 * 0.3e0 + 50 / 1000000e0 * 2.5e0 END AS cost_usd,
  CASE WHEN base.k IS NOT NULL THEN CAST(base.k % 997 + 300 AS INTEGER) END AS latency_ms,
  CASE WHEN base.k IS NOT NULL AND shown.issues <> '' THEN shown.issues END AS issues,
  last.stage AS job_stage, last.status AS job_status
FROM docs LEFT JOIN base ON base.document_id = docs.document_id
LEFT JOIN shown ON shown.document_id = docs.document_id
LEFT JOIN kids ON kids.document_id = docs.document_id
LEFT JOIN (SELECT CAST(replace(document_id, 'u', '') AS BIGINT) AS k,
    max_by(stage, strftime(created_at, '%Y%m%d%H%M%S%f') || id) AS stage,
    max_by(status, strftime(created_at, '%Y%m%d%H%M%S%f') || id) AS status
  FROM jobs GROUP BY document_id) AS last ON last.k = docs.k""")
def document_detail(t):
    issues = issue_rows(validate_records(b.records(t)), "rule_issues", "extraction_id")
    calls = record.model_cost(b.base(t).select(
        "document_id", F.concat("document_id", F.lit("-1")).alias("extraction_id"),
        F.lit("cheap").alias("tier"), F.lit(1).alias("attempt_no"),
        (F.col("k") % 100 + 500).alias("input_tokens"), F.lit(50).alias("output_tokens"),
        (F.col("k") % 997 + 300).cast("int").alias("latency_ms"),
    ))
    data = b.records(t).select("document_id", F.col("record").alias("data"))
    latest_rows = calls.join(data, "document_id").withColumn("model", F.col("tier")).drop("tier")
    jobs = joblog.jobs(t).withColumn("document_id", F.concat(
        F.lit("D"), F.lpad(F.substring("document_id", 2, 20), 12, "0")))
    detail = review.document_detail(
        documents(t), _page_rows(t), latest_rows, field_values(t), issues, jobs
    )
    return detail.select(
        "document_id", "tenant_id", "filename", "doc_type", "status", "confidence",
        F.col("split_from_document_id").alias("parent"),
        F.coalesce(joined(F.col("child_document_ids")), F.lit("")).alias("children"),
        joined(F.transform("pages", lambda p: F.concat_ws(":", p["page_no"], p["text_source"]))).alias("pages"),
        F.when(F.col("fields").isNotNull(), F.size("fields")).alias("n_fields"),
        "data.total", "data.currency", F.size("data.line_items").alias("n_items"), "extraction_id",
        "model", "attempt_no", "input_tokens", "cost_usd", "latency_ms",
        joined(F.array_sort(F.transform("issues", lambda i: F.concat_ws(":", i["rule"], i["field"]))))
        .alias("issues"),
        F.col("last_job.stage").alias("job_stage"), F.col("last_job.status").alias("job_status"),
    )


@query("page_image", "WITH " + b.BASE_SQL + """
SELECT document_id, p AS page_no, CASE WHEN p < 3 THEN document_id || '_page' || p || '.png' END AS image_key,
  p < 3 AS found FROM base CROSS JOIN range(1, 4) AS r(p)""")
def page_image(t):
    asked = b.base(t).select("document_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page_no"))
    return review.page_images(_page_rows(t), asked)


@query("review_overlay", LONG_SQL + "," + DOCS_SQL + """
SELECT docs.document_id, docs.status, found.field, page_no, x0 / 400e0 * 100e0 AS left_pct,
  20e0 / 200e0 * 100e0 AS top_pct, (x1 - x0) / 400e0 * 100e0 AS width_pct,
  (30e0 - 20e0) / 200e0 * 100e0 AS height_pct
FROM docs JOIN found ON found.extraction_id = docs.document_id || '-2'""")
def review_overlay(t):
    pages = _page_rows(t).select(
        "document_id", "page_no", F.lit(400.0).alias("page_width"), F.lit(200.0).alias("page_height")
    )
    second = b.answers(t).where(F.col("attempt_no") == 2).select("document_id", "extraction_id")
    # The rows are written, so that what was shuffled to ground them is gone when they are joined.
    values = materialise(long_rows(t).select("extraction_id", "field", "page_no", "bbox"), "values")
    shown = review.fields_on_pages(documents(t), pages, second, values)
    percent = review.bbox_percent(F.col("bbox"), F.col("page_width"), F.col("page_height"))
    return shown.select("document_id", "status", "field", "page_no", percent.alias("p")).select(
        "document_id", "status", "field", "page_no", "p.*"
    )


@query("approved_outbox", "WITH " + b.BASE_SQL + "," + DOCS_SQL + """
SELECT docs.document_id, 'document.approved' AS event, docs.tenant_id, docs.doc_type, docs.confidence, base.total
FROM docs LEFT JOIN base ON base.document_id = docs.document_id WHERE status = 'approved'""")
def approved_outbox(t):
    data = b.records(t).select("document_id", F.col("record").alias("data"))
    events = ingest.approved_outbox(documents(t), data)

    def at(path):
        return F.get_json_object("payload", path)

    return events.select(
        at("$.document_id").alias("document_id"), at("$.event").alias("event"),
        at("$.tenant_id").alias("tenant_id"), at("$.doc_type").alias("doc_type"),
        at("$.confidence").cast("double").alias("confidence"),
        at("$.data.total").cast("double").alias("total"),
    )


"""Record checks, cross-document checks and the trust decision as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerproof.catalog import base as b
from ledgerproof.catalog.core import joined, query
from ledgerproof.config import ALL_FIELDS, DEFAULTS
from ledgerproof.functions.issues import issue_list
from ledgerproof.operators import cross, ground, review, rules, trust
from ledgerproof.operators.record import build_records, field_values_long
from ledgerproof.plans import trust as plan
from ledgerproof.session import materialise

FIXED = "format('{:.2f}', %s)"
WITH_BASE = "WITH " + b.BASE_SQL
WITH_ANS = "WITH " + b.ANSWERS_SQL

REQ_SQL = {
    f: f"CASE WHEN {f} IS NULL{' OR ' + f + chr(61) + chr(39) * 2 if f in ('supplier', 'invoice_number') else ''}"
       f" THEN 'Required field ''{f}'' is missing' END"
    for f in ("supplier", "invoice_number", "invoice_date", "total")
}
LINE_SQL = (
    "CASE WHEN abs(line_sum - subtotal) > 0.02e0 THEN 'Line items sum to ' || "
    + FIXED % "line_sum" + " || ' but subtotal is ' || " + FIXED % "subtotal" + " END"
)
TOTAL_SQL = (
    "CASE WHEN abs(subtotal + tax - total) > 0.02e0 THEN 'subtotal (' || " + FIXED % "subtotal"
    + " || ') + tax (' || " + FIXED % "tax" + " || ') = ' || " + FIXED % "(subtotal + tax)"
    + " || ' but total is ' || " + FIXED % "total" + " END"
)
DUE_SQL = (
    "CASE WHEN due_date < invoice_date THEN 'Due date ' || CAST(due_date AS VARCHAR) || "
    "' is before invoice date ' || CAST(invoice_date AS VARCHAR) END"
)
CURRENCY_SQL = (
    f"CASE WHEN upper(currency) NOT IN ({b._codes()}) THEN '''' || currency || "
    "''' is not a recognized ISO 4217 currency code' END"
)
# rule, severity, field, message in the order the rules run
RULES_SQL = [
    *[("missing_required_field", "error", f, m) for f, m in REQ_SQL.items()],
    ("line_items_subtotal_mismatch", "error", "subtotal", LINE_SQL),
    ("total_mismatch", "error", "total", TOTAL_SQL),
    ("due_date_before_invoice_date", "error", "due_date", DUE_SQL),
    ("invalid_currency", "warning", "currency", CURRENCY_SQL),
]
# The rules and fields of a record's issues, sorted, as one text.
RULE_NAMES_SQL = "array_to_string(list_sort(list_filter([" + ", ".join(
    f"CASE WHEN ({m}) IS NOT NULL THEN '{r}:{f}' END" for r, _, f, m in RULES_SQL
) + "], lambda x: x IS NOT NULL)), '|')"
COLUMNS = ("document_id", "rule", "severity", "field", "message")


def rules_sql(picked, source="base", ids="document_id"):
    parts = [
        f"SELECT {ids}, '{r}' AS rule, '{s}' AS severity, '{f}' AS field, {m} AS message FROM {source}"
        for r, s, f, m in picked
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") AS u WHERE message IS NOT NULL"


def _one_rule(t, *conditional):
    rows = b.records(t).withColumn("issues", issue_list(*conditional))
    return rules.issue_rows(rows, "issues", "document_id").select(*COLUMNS)


def _r(name):
    return F.col(f"record.{name}")


@query("rule_required", WITH_BASE + rules_sql(RULES_SQL[:4]))
def rule_required(t):
    return _one_rule(t, *[rules.required_field(f, _r(f)) for f in REQ_SQL])


@query("rule_line_sum", WITH_BASE + rules_sql(RULES_SQL[4:5]))
def rule_line_sum(t):
    return _one_rule(
        t, rules.line_items_rule(_r("line_items"), _r("subtotal"), DEFAULTS.amount_tolerance)
    )


@query("rule_total", WITH_BASE + rules_sql(RULES_SQL[5:6]))
def rule_total(t):
    return _one_rule(
        t, rules.total_rule(_r("subtotal"), _r("tax"), _r("total"), DEFAULTS.amount_tolerance)
    )


@query("rule_due_date", WITH_BASE + rules_sql(RULES_SQL[6:7]))
def rule_due_date(t):
    return _one_rule(t, rules.due_date_rule(_r("invoice_date"), _r("due_date")))


@query("rule_currency", WITH_BASE + rules_sql(RULES_SQL[7:8]))
def rule_currency(t):
    return _one_rule(t, rules.currency_rule(_r("currency")))


@query("validate_record", WITH_BASE + rules_sql(RULES_SQL))
def validate_record(t):
    checked = rules.validate_records(b.records(t))
    return rules.issue_rows(checked, "rule_issues", "document_id").select(*COLUMNS)


# --- cross-document checks -------------------------------------------------

KEYS_SQL = """,
keyed AS (
  SELECT document_id, tenant_id, supplier, invoice_number,
    lower(trim(coalesce(supplier, ''))) AS ns, lower(trim(coalesce(invoice_number, ''))) AS nn
  FROM base),
ranked AS (
  SELECT tenant_id, ns, nn, document_id,
    row_number() OVER (PARTITION BY tenant_id, ns, nn ORDER BY document_id) AS rn FROM keyed),
pairs AS (
  SELECT tenant_id, ns, nn, min(document_id) AS a,
    max(CASE WHEN rn = 2 THEN document_id END) AS b
  FROM ranked WHERE rn <= 2 GROUP BY tenant_id, ns, nn),
dups AS (
  SELECT k.document_id, k.tenant_id, k.supplier, k.invoice_number,
    CASE WHEN p.a <> k.document_id THEN p.a ELSE p.b END AS other_id
  FROM keyed k JOIN pairs p ON p.tenant_id = k.tenant_id AND p.ns = k.ns AND p.nn = k.nn
  WHERE k.supplier <> '' AND k.invoice_number <> '')
"""


def _targets(t):
    r = b.records(t)
    return r.select("extraction_id", "document_id", "tenant_id", "attempt_no",
                    "record.supplier", "record.invoice_number")


@query("duplicate_invoice", WITH_BASE + KEYS_SQL + """
SELECT document_id, tenant_id, other_id FROM dups WHERE other_id IS NOT NULL""")
def duplicate_invoice(t):
    targets = _targets(t)
    return cross.duplicate_invoices(targets, targets).select("document_id", "tenant_id", "other_id")


@query("duplicate_invoice_as_of", WITH_BASE + KEYS_SQL + """,
dated AS (SELECT keyed.*, base.invoice_date AS created_at FROM keyed JOIN base USING (document_id)),
firsts AS (
  SELECT tenant_id, ns, nn, document_id, created_at,
    row_number() OVER (PARTITION BY tenant_id, ns, nn ORDER BY created_at, document_id) AS rn
  FROM dated)
SELECT d.document_id, d.tenant_id, f.document_id AS other_id
FROM dated d JOIN firsts f ON f.tenant_id = d.tenant_id AND f.ns = d.ns AND f.nn = d.nn AND f.rn = 1
WHERE d.supplier <> '' AND d.invoice_number <> '' AND f.document_id <> d.document_id
  AND f.created_at < d.created_at""")
def duplicate_invoice_as_of(t):
    r = b.records(t)
    targets = r.select("extraction_id", "document_id", "tenant_id", "record.supplier",
                       "record.invoice_number", F.col("record.invoice_date").alias("created_at"))
    return cross.earlier_duplicates(targets, targets).select("document_id", "tenant_id", "other_id")


@query("duplicate_after_correction", WITH_BASE + """,
own AS (
  SELECT document_id, tenant_id, lower(trim(coalesce(supplier, ''))) AS ns,
    lower(trim(coalesce(invoice_number, ''))) AS nn FROM base
  WHERE supplier <> '' AND invoice_number <> ''),
now AS (
  SELECT document_id, tenant_id, lower(trim(coalesce(supplier, ''))) AS ns,
    CASE WHEN k % 10 = 0 THEN 'inv-1' ELSE lower(trim(coalesce(invoice_number, ''))) END AS nn FROM base)
SELECT own.document_id, own.tenant_id, min(now.document_id) AS other_id FROM own JOIN now
  ON now.tenant_id = own.tenant_id AND now.ns = own.ns AND now.nn = own.nn AND now.document_id <> own.document_id
GROUP BY own.document_id, own.tenant_id""")
def duplicate_after_correction(t):
    """Records against the current, human-corrected values of the others."""
    rows = b.records(t).withColumn("matches", ground.no_matches())
    ids = rows.select("extraction_id", "document_id", "tenant_id")
    values = field_values_long(rows).withColumn("confidence", F.lit(0.5))
    asked = b.base(t).where(F.col("k") % 10 == 0).select(
        "document_id", F.lit("invoice_number").alias("field"), F.lit(1).cast("bigint").alias("seq"),
        F.lit("INV-1").alias("new_value"), F.lit("r").alias("reviewer"),
    )
    corrected = review.apply_corrections(values, review.effective_corrections(asked, ids, values))
    return cross.duplicate_invoices(_targets(t), cross.current_values(ids, corrected)).select(
        "document_id", "tenant_id", "other_id"
    )


@query("unknown_supplier", WITH_BASE + "," + b.SUPPLIERS_SQL + """
SELECT document_id, tenant_id, supplier FROM base WHERE supplier <> '' AND NOT EXISTS (
  SELECT 1 FROM known WHERE known.tenant_id = base.tenant_id
    AND lower(known.name) = lower(trim(base.supplier)))""")
def unknown_supplier(t):
    return cross.unknown_suppliers(_targets(t), b.suppliers(t)).select(
        "document_id", "tenant_id", "supplier"
    )


@query("latest_extraction", WITH_ANS + """
SELECT document_id, max(attempt_no) AS attempt_no, max_by(extraction_id, attempt_no) AS extraction_id,
  max_by(total, attempt_no) AS total
FROM ans GROUP BY document_id""")
def latest_extraction(t):
    built = build_records(b.answers(t)).withColumn("total", F.col("record.total"))
    return cross.latest_attempts(built, "extraction_id", "total")


ALL_ISSUES_SQL = WITH_BASE + KEYS_SQL + "," + b.SUPPLIERS_SQL + """,
issue_rows AS (""" + rules_sql(RULES_SQL, ids="document_id, tenant_id") + """
  UNION ALL
  SELECT document_id, tenant_id, 'duplicate_invoice_number', 'warning', 'invoice_number',
    'Invoice number ''' || invoice_number || ''' from supplier ''' || supplier
    || ''' already exists on document ' || other_id FROM dups WHERE other_id IS NOT NULL
  UNION ALL
  SELECT document_id, tenant_id, 'unknown_supplier', 'warning', 'supplier',
    'Supplier ''' || supplier || ''' is not in the known-suppliers list for this tenant'
  FROM base WHERE supplier <> '' AND NOT EXISTS (
    SELECT 1 FROM known WHERE known.tenant_id = base.tenant_id
      AND lower(known.name) = lower(trim(base.supplier))))
"""


def all_issues(t):
    """Record and cross-document issues of the base records as rows."""
    checked = rules.validate_records(b.records(t))
    own = rules.issue_rows(checked, "rule_issues", "extraction_id", "document_id", "tenant_id")
    targets = _targets(t)
    return own.unionByName(cross.cross_issues(targets, targets, b.suppliers(t)))


@query("cross_issues", ALL_ISSUES_SQL + """
SELECT document_id, rule, severity, field, message FROM issue_rows
WHERE rule IN ('duplicate_invoice_number', 'unknown_supplier')""")
def cross_issues(t):
    targets = _targets(t)
    return cross.cross_issues(targets, targets, b.suppliers(t)).select(*COLUMNS)


@query("document_issues", ALL_ISSUES_SQL + """
SELECT document_id, tenant_id, rule, severity, field, message FROM issue_rows""")
def document_issues(t):
    return all_issues(t).select("document_id", "tenant_id", "rule", "severity", "field", "message")


@query("issue_profile", ALL_ISSUES_SQL + """
SELECT tenant_id, rule, severity, count(*) AS n_issues FROM issue_rows
GROUP BY tenant_id, rule, severity""")
def issue_profile(t):
    return rules.issue_profile(all_issues(t))


# --- trust decision --------------------------------------------------------

def built_once(t):
    """The records of both attempts and failures, for a plan that reads them once."""
    return build_records(b.answers(t)).select(
        "extraction_id", "document_id", "tenant_id", "attempt_no", "review", "record", "hints",
        "pre_issues", "build_error",
    )


def sound(t):
    """The records of both attempts, written once for plans that read them twice.

    Failures are left out on reading: before the write, the filter would be pushed below the parsing,
    where each answer would be made and parsed again for it.
    """
    return materialise(built_once(t), "records").where(F.col("build_error").isNull()).drop("build_error")


def checked(t, built=None):
    """Both attempts judged, also from `sound` records; flags stand in for the record."""
    return plan.judge_flags(built_once(t) if built is None else built, b.pages(t))


def final(t, rows=None):
    rows = trust.severity_counts(checked(t) if rows is None else rows)
    return trust.final_attempts(rows, "extraction_id", "tenant_id", "signals", "n_errors",
                                "n_warnings")


def decided(t, rows=None):
    """The decision with its scores, written first: the filter on the list of scores that `inline`
    brings would otherwise be pushed below the steps that make it."""
    return materialise(trust.decide(final(t, rows)).select("extraction_id", "scores"), "decided")


REASONS_SQL = """
concat_ws(chr(10), CASE WHEN e_supplier = 1 THEN 'Required field ''supplier'' is missing' END,
  CASE WHEN e_number = 1 THEN 'Required field ''invoice_number'' is missing' END,
  CASE WHEN e_date = 1 THEN 'Required field ''invoice_date'' is missing' END,
  """ + LINE_SQL + ", " + TOTAL_SQL + ", " + DUE_SQL + """,
  'Could not verify these fields actually appear in the document text as claimed: ' || nullif(
    concat_ws(', ', CASE WHEN supplier IS NOT NULL AND NOT g_supplier THEN 'supplier' END,
      CASE WHEN invoice_number IS NOT NULL AND NOT g_number THEN 'invoice_number' END,
      CASE WHEN invoice_date IS NOT NULL AND NOT g_date THEN 'invoice_date' END,
      CASE WHEN total IS NOT NULL AND NOT g_total THEN 'total' END), ''),
  CASE WHEN agrees_total IS NOT DISTINCT FROM false THEN
    'An independent review flagged these fields as not matching their cited source text: total' END)"""


@query("escalation", WITH_ANS + "SELECT extraction_id, suspect FROM judged")
def escalation(t):
    return checked(t).select("extraction_id", "suspect")


@query("escalation_reasons", WITH_ANS + "SELECT extraction_id, " + REASONS_SQL
       + " AS reasons FROM judged WHERE suspect")
def escalation_reasons(t):
    return checked(t).where("suspect").select(
        "extraction_id", joined(F.col("reasons"), "\n").alias("reasons")
    )


@query("final_attempt", WITH_ANS + """
SELECT document_id, tenant_id, extraction_id, attempt_no, escalated, n_errors, n_warnings FROM final""")
def final_attempt(t):
    return final(t).select("document_id", "tenant_id", "extraction_id", "attempt_no", "escalated",
                           "n_errors", "n_warnings")


SIGNAL_SQL = {
    "supplier": "s_supplier", "invoice_number": "s_number", "invoice_date": "s_date",
    "due_date": "s_due", "currency": "s_currency", "subtotal": "s_subtotal", "tax": "s_tax",
    "total": "s_total",
}


@query("field_confidence", WITH_ANS + " UNION ALL ".join(
    f"SELECT extraction_id, '{f}' AS field, ({c} + CASE WHEN escalated THEN 0 ELSE 1 END) / 4e0 "
    "AS confidence FROM final" for f, c in SIGNAL_SQL.items()))
def field_confidence(t):
    return decided(t).select("extraction_id", F.inline("scores"))


@query("document_confidence", WITH_ANS + "SELECT document_id, confidence FROM final")
def document_confidence(t):
    return trust.decide(final(t)).select("document_id", "confidence")


STATUS_SQL = "CASE WHEN confidence >= 0.75e0 THEN 'approved' ELSE 'needs_review' END"


@query("approval_gate", WITH_ANS + f"""
SELECT tenant_id, escalated, {STATUS_SQL} AS status, count(*) AS n_documents FROM final
GROUP BY tenant_id, escalated, {STATUS_SQL}""")
def approval_gate(t):
    return trust.decide(final(t)).groupBy("tenant_id", "escalated", "status").agg(
        F.count("*").alias("n_documents")
    )


@query("confidence_band", WITH_ANS + """
SELECT CASE WHEN confidence IS NULL THEN 'mid' WHEN confidence >= 0.75e0 THEN 'high'
    WHEN confidence >= 0.5e0 THEN 'mid' ELSE 'low' END AS band, count(*) AS n_documents
FROM final GROUP BY 1""")
def confidence_band(t):
    return (
        trust.decide(final(t))
        .groupBy(trust.confidence_band(F.col("confidence")).alias("band"))
        .agg(F.count("*").alias("n_documents"))
    )


@query("trust_flow", WITH_ANS + "," + b.SUPPLIERS_SQL + f""",
keyed AS (
  SELECT *, lower(trim(coalesce(supplier, ''))) AS ns, lower(trim(coalesce(invoice_number, ''))) AS nn
  FROM final),
sizes AS (SELECT tenant_id, ns, nn, count(*) AS n FROM keyed GROUP BY tenant_id, ns, nn),
flags AS (
  SELECT keyed.*, (supplier <> '' AND invoice_number <> '' AND n > 1) IS TRUE AS dup,
    (supplier <> '' AND NOT EXISTS (SELECT 1 FROM known WHERE known.tenant_id = keyed.tenant_id
      AND lower(known.name) = keyed.ns)) IS TRUE AS unk
  FROM keyed JOIN sizes USING (tenant_id, ns, nn))
SELECT document_id, tenant_id, attempt_no, escalated, false AS pending, confidence,
  {STATUS_SQL} AS status, n_errors,
  n_warnings + CASE WHEN dup THEN 1 ELSE 0 END + CASE WHEN unk THEN 1 ELSE 0 END AS n_warnings,
  dup AS is_duplicate, unk AS unknown_supplier, CAST(NULL AS VARCHAR) AS error
FROM flags""")
def trust_flow(t):
    return plan.trust_flow(b.answers(t), b.pages(t), b.suppliers(t))


def broken_answers(t):
    """Answers of which some are no record, in the first or second attempt, or still to come."""
    rows = b.answers(t)
    first, k = F.col("attempt_no") == 1, F.col("k")
    raw = F.when(first & (k % 13 == 0), "not json").when(~first & (k % 11 == 0), "[]")
    return rows.where(first | (k % 17 != 3)).withColumn("raw", F.coalesce(raw, F.col("raw")))


@query("trust_outcomes", WITH_ANS + f""",
tries2 AS (
  SELECT o.document_id, o.k, o.suspect, f.confidence, f.attempt_no
  FROM judged o JOIN final f ON f.document_id = o.document_id WHERE o.attempt_no = 1)
SELECT document_id, CASE WHEN k % 13 = 0 THEN 'failed' WHEN NOT suspect THEN {STATUS_SQL}
    WHEN k % 17 = 3 THEN 'extracted' WHEN k % 11 = 0 THEN 'failed' ELSE {STATUS_SQL} END AS status,
  k % 13 <> 0 AND suspect AND k % 17 = 3 AS pending,
  CASE WHEN k % 13 = 0 OR NOT suspect OR k % 17 = 3 THEN 1 ELSE 2 END AS attempt_no,
  CASE WHEN k % 13 = 0 OR (suspect AND (k % 17 = 3 OR k % 11 = 0)) THEN NULL ELSE confidence END AS confidence,
  k % 13 = 0 OR (suspect AND k % 17 <> 3 AND k % 11 = 0) AS has_error
FROM tries2""")
def trust_outcomes(t):
    return plan.trust_flow(broken_answers(t), b.pages(t), b.suppliers(t)).select(
        "document_id", "status", "pending", "attempt_no", "confidence",
        F.col("error").isNotNull().alias("has_error"),
    )


@query("failed_answers", WITH_ANS + """
SELECT extraction_id, document_id, attempt_no FROM judged
WHERE (attempt_no = 1 AND k % 13 = 0) OR (attempt_no = 2 AND k % 11 = 0 AND k % 17 <> 3)""")
def failed_answers(t):
    return plan.failed_answers(broken_answers(t)).select("extraction_id", "document_id", "attempt_no")


EXTRACTION_ISSUES = (
    ("e_supplier", "missing_required_field", "error", "supplier"),
    ("e_number", "missing_required_field", "error", "invoice_number"),
    ("e_date", "missing_required_field", "error", "invoice_date"),
    ("e_lines", "line_items_subtotal_mismatch", "error", "subtotal"),
    ("e_total", "total_mismatch", "error", "total"),
    ("e_due", "due_date_before_invoice_date", "error", "due_date"),
    ("w_currency", "invalid_currency", "warning", "currency"),
    ("w_items", "unparseable_field", "warning", "line_items"),
    ("w_number", "unparseable_field", "warning", "invoice_number"),
    ("w_date", "unparseable_field", "warning", "invoice_date"),
    ("w_tax", "unparseable_field", "warning", "tax"),
)


@query("extraction_issues", WITH_ANS + "," + b.SUPPLIERS_SQL + " UNION ALL ".join(
    f"SELECT extraction_id, document_id, '{rule}' AS rule, '{severity}' AS severity, '{field}' AS field "
    f"FROM judged WHERE {flag} = 1" for flag, rule, severity, field in EXTRACTION_ISSUES)
    + """ UNION ALL SELECT extraction_id, document_id, 'unknown_supplier', 'warning', 'supplier' FROM judged
WHERE supplier <> '' AND NOT EXISTS (SELECT 1 FROM known WHERE known.tenant_id = judged.tenant_id
  AND lower(known.name) = lower(trim(judged.supplier)))""")
def extraction_issues(t):
    """The issue table over both attempts: what was dropped, the rules, unknown suppliers."""
    built = sound(t)
    rows = checked(t, built)
    columns = ("extraction_id", "document_id", "rule", "severity", "field")
    # The targets are read from the records: those of `rows` would be checked once more.
    unknown = cross.unknown_suppliers(plan.targets_of(built), b.suppliers(t)).select(
        "extraction_id", "document_id", F.lit("unknown_supplier").alias("rule"),
        F.lit("warning").alias("severity"), F.lit("supplier").alias("field"),
    )
    return plan.record_issues(rows).select(*columns).unionByName(unknown)


@query("confidence_write_back", WITH_ANS + " UNION ALL ".join(
    f"SELECT j.extraction_id, '{f}' AS field, CASE WHEN f.extraction_id IS NOT NULL THEN "
    f"(f.{c} + CASE WHEN f.escalated THEN 0 ELSE 1 END) / 4e0 END AS confidence "
    "FROM judged j LEFT JOIN final f ON f.extraction_id = j.extraction_id"
    for f, c in SIGNAL_SQL.items())
    + " UNION ALL SELECT extraction_id, 'line_items', CAST(NULL AS DOUBLE) FROM judged")
def confidence_write_back(t):
    built = sound(t)
    rows = checked(t, built)
    fields = F.array(*[F.lit(f) for f in (*ALL_FIELDS, "line_items")])
    # One value per record and field, read from the records: `rows` would be checked once more.
    values = built.select("extraction_id", F.explode(fields).alias("field")).withColumn(
        "confidence", F.lit(None).cast("double")
    )
    return trust.write_back(values, decided(t, rows)).select(
        "extraction_id", "field", "confidence"
    )


@query("grounding_coverage", WITH_ANS + " UNION ALL ".join(
    f"SELECT '{f}' AS field, sum(CASE WHEN {f} IS NOT NULL THEN 1 ELSE 0 END) AS n_present, "
    f"sum(CASE WHEN {f} IS NOT NULL AND {g} THEN 1 ELSE 0 END) AS n_grounded FROM ans"
    for f, g in zip(ALL_FIELDS, ("g_supplier", "g_number", "g_date", "g_due", "g_currency",
                                 "g_subtotal", "g_tax", "g_total"))))
def grounding_coverage(t):
    built = materialise(
        build_records(b.answers(t)).select("extraction_id", "document_id", "record", "hints"), "records"
    )
    return ground.grounding_coverage(ground.ground_records(built, b.pages(t)))

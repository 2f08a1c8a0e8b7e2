"""Read queries over documents and the effects of human review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from ledgerproof.config import ALL_FIELDS, DEFAULTS, NUMBER_FIELDS, TERMINAL_STATUSES, Settings
from ledgerproof.operators.ingest import approved_outbox


def list_documents(
    documents: DataFrame, tenant_id: str | None = None, status: str | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """The newest documents, up to the list limit; ties by id."""
    if tenant_id is not None:
        documents = documents.where(F.col("tenant_id") == tenant_id)
    if status is not None:
        documents = documents.where(F.col("status") == status)
    return (
        documents.select(
            F.col("id").alias("document_id"), "tenant_id", "filename", "doc_type", "status",
            "confidence", "created_at",
        )
        .orderBy(F.col("created_at").desc(), "document_id")
        .limit(settings.list_limit)
    )


def review_queue(documents: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """All documents that need review, oldest first."""
    waiting = documents.where(F.col("status") == "needs_review")
    if tenant_id is not None:
        waiting = waiting.where(F.col("tenant_id") == tenant_id)
    return waiting.select(
        F.col("id").alias("document_id"), "tenant_id", "filename", "confidence", "created_at"
    ).orderBy("created_at", "document_id")


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The newest job per document; ties by id."""
    return jobs.groupBy("document_id").agg(
        F.max_by(
            F.struct("id", "stage", "status", "attempts", "last_error"),
            F.struct("created_at", "id"),
        ).alias("job")
    ).select(
        "document_id", F.col("job.id").alias("job_id"), "job.stage", "job.status", "job.attempts",
        "job.last_error",
    )


def document_detail(
    documents: DataFrame, pages: DataFrame, latest: DataFrame, field_values: DataFrame,
    issues: DataFrame, jobs: DataFrame,
) -> DataFrame:
    """One nested row per document with its parts.

    `latest` has `document_id, extraction_id` and whatever of the latest extraction is to be shown
    (`model, attempt_no, data, tokens, cost_usd, latency_ms`). Lists are whole: the pages and
    children of one document, the fields and issues of one extraction (at most a few per field,
    line item and rule).
    """
    page_list = pages.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("page_no", "text_source", "image_key"))).alias("pages"),
        F.count("*").alias("n_pages"),
    )
    children = documents.where(F.col("split_from_document_id").isNotNull()).groupBy(
        F.col("split_from_document_id").alias("document_id")
    ).agg(
        F.array_sort(F.collect_list("id")).alias("child_document_ids"),
        F.count("*").alias("n_children"),
    )
    fields = field_values.groupBy("extraction_id").agg(
        F.array_sort(
            F.collect_list(F.struct("field", "value", "page_no", "bbox", "confidence"))
        ).alias("fields")
    )
    found = issues.groupBy("extraction_id").agg(
        F.array_sort(
            F.collect_list(F.struct("field", "rule", "severity", "message"))
        ).alias("issues"),
        F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
    )
    job = latest_jobs(jobs).select(
        "document_id", F.struct("stage", "status", "attempts", "last_error").alias("last_job")
    )
    return (
        documents.withColumnRenamed("id", "document_id")
        .join(page_list, "document_id", "left")
        .join(children, "document_id", "left")
        .join(latest, "document_id", "left")
        .join(job, "document_id", "left")
        .join(fields, "extraction_id", "left")
        .join(found, "extraction_id", "left")
    )


def page_images(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """The image key of each asked page (`document_id, page_no`); null where there is none."""
    keys = ["document_id", "page_no"]
    return asked.join(pages.select(*keys, "image_key"), keys, "left").select(
        *keys, "image_key", F.col("image_key").isNotNull().alias("found")
    )


def fields_on_pages(
    documents: DataFrame, pages: DataFrame, latest: DataFrame, field_values: DataFrame
) -> DataFrame:
    """The boxes to draw: fields of the latest extraction on each page."""
    located = field_values.where(F.col("bbox").isNotNull()).join(
        latest.select("extraction_id", "document_id"), "extraction_id"
    )
    page = pages.select("document_id", "page_no", "page_width", "page_height")
    status = documents.select(F.col("id").alias("document_id"), "status")
    return located.join(page, ["document_id", "page_no"]).join(status, "document_id")


def bbox_percent(bbox: Column, width: Column, height: Column) -> Column:
    """left, top, width and height of a box in percent of its page image."""
    def at(k):
        return F.get(bbox, F.lit(k))
    return F.struct(
        (at(0) / width * 100).alias("left_pct"),
        (at(1) / height * 100).alias("top_pct"),
        ((at(2) - at(0)) / width * 100).alias("width_pct"),
        ((at(3) - at(1)) / height * 100).alias("height_pct"),
    )


# How a browser reads a number, and its white space.
DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
FORM_SPACE = "[\\t-\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def form_number(text: Column) -> Column:
    """The number that a trimmed form entry means, null if it is none: decimal, or digits after 0x,
    0o or 0b."""
    decimal = F.when(text.rlike(rf"\A{DECIMAL}\z"), text.try_cast("double"))
    endless = F.when(
        text.rlike(r"\A[+-]?Infinity\z"),
        F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))),
    )

    def based(pattern: str, base: int) -> Column:
        digits = F.filter(F.split(F.substring(F.lower(text), 3, 1 << 30), ""), lambda d: d != "")
        return F.when(text.rlike(rf"\A0{pattern}+\z"), F.aggregate(
            digits, F.lit(0.0), lambda total, d: total * base + F.instr(F.lit("0123456789abcdef"), d) - 1
        ))

    return F.coalesce(
        decimal, endless, based("[xX][0-9a-fA-F]", 16), based("[oO][0-7]", 8), based("[bB][01]", 2)
    )


def same_value(field: Column, old: Column, new: Column) -> Column:
    """Numbers in number fields are equal as doubles, everything else as text."""
    number = field.isin(*NUMBER_FIELDS)
    a, b = F.when(number, form_number(old)), F.when(number, form_number(new))
    return F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(old.eqNullSafe(new))


def effective_corrections(
    corrections: DataFrame, latest: DataFrame, field_values: DataFrame
) -> DataFrame:
    """Corrections that change something: existing field, different value.

    `corrections` has `seq`, the order they came in. Each is compared with what the one before it
    left, so `old_value` and `new_value` of a field form a chain.
    """
    asked = corrections.join(latest.select("document_id", "extraction_id"), "document_id")
    current = field_values.select("extraction_id", "field", F.col("value").alias("first_value"))
    return changing(asked.join(current, ["extraction_id", "field"]))


def changing(asked: DataFrame) -> DataFrame:
    """Of corrections with the `first_value` of their field those that change something, with
    `old_value`."""
    order = Window.partitionBy("extraction_id", "field").orderBy("seq")
    # An unchanged value leaves what the one before it left, so looking one back is enough.
    return (
        asked.withColumn("nth", F.row_number().over(order))
        .withColumn("before", F.lag("new_value").over(order))
        .withColumn(
            "old_value",
            F.when(F.col("nth") == 1, F.col("first_value")).otherwise(F.col("before")),
        )
        .where(~same_value(F.col("field"), F.col("old_value"), F.col("new_value")))
        .drop("nth", "before", "first_value")
    )


def changing_of(field: str, value: str, asked: str) -> Column:
    """`changing` for a value and the list of its corrections in order (structs with `seq` and
    `new_value`): those that change something."""
    def old(i):
        return F.when(i == 0, F.col(value)).otherwise(F.get(asked, i - 1)["new_value"])

    numbered = F.transform(asked, lambda c, i: F.struct(
        c["seq"].alias("seq"), c["new_value"].alias("new_value"), old(i).alias("old_value")
    ))
    return F.transform(
        F.filter(numbered, lambda c: ~same_value(F.col(field), c["old_value"], c["new_value"])),
        lambda c: F.struct(c["seq"].alias("seq"), c["new_value"].alias("new_value")),
    )


def correction_audit(effective: DataFrame) -> DataFrame:
    return effective.select(
        "document_id", "extraction_id", "field", "seq", "old_value", "new_value", "reviewer"
    )


def apply_corrections(field_values: DataFrame, effective: DataFrame) -> DataFrame:
    """New field values: the last correction of each field counts and is fully trusted."""
    changed = effective.groupBy("extraction_id", "field").agg(
        F.max_by(F.struct("new_value"), "seq")["new_value"].alias("new_value"),
        F.lit(True).alias("changed"),
    )
    hit = F.coalesce("changed", F.lit(False))
    return (
        field_values.join(changed, ["extraction_id", "field"], "left")
        .withColumn("value", F.when(hit, F.col("new_value")).otherwise(F.col("value")))
        .withColumn("confidence", F.when(hit, F.lit(1.0)).otherwise(F.col("confidence")))
        .drop("new_value", "changed")
    )


def corrected_data(field_values: DataFrame, latest: DataFrame) -> DataFrame:
    """`document_id, data`: the field values of each document's latest extraction as one struct, for
    its event. Numbers are numbers."""
    names = [*ALL_FIELDS, "line_items"]

    def typed(f):
        value = F.max(F.when(F.col("field") == f, F.col("value")))
        return form_number(value) if f in NUMBER_FIELDS else value

    return latest.select("document_id", "extraction_id").join(field_values, "extraction_id").groupBy(
        "document_id"
    ).agg(*[typed(f).alias(f) for f in names]).select("document_id", F.struct(*names).alias("data"))


def submit_corrections(
    documents: DataFrame, corrections: DataFrame, latest: DataFrame, field_values: DataFrame,
    reviewed: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A review round as one flow: the new field values, the audit rows, the documents (reviewed
    ones approved), and an event per document approved here, with its data as corrected.

    `reviewed` has the `document_id` of every submitted review, also those without a correction; by
    default those of the corrections.
    """
    reviewed = corrections if reviewed is None else reviewed
    effective = effective_corrections(corrections, latest, field_values)
    values = apply_corrections(field_values, effective)
    approved = approve_corrected(documents, reviewed, latest)
    done = approved.join(
        reviewed.select(F.col("document_id").alias("id")).distinct(), "id", "left_semi"
    )
    events = approved_outbox(done, corrected_data(values, latest))
    return values, correction_audit(effective), approved, events


def approve_corrected(
    documents: DataFrame, reviewed: DataFrame, latest: DataFrame
) -> DataFrame:
    """Approve every reviewed document that has an extraction, changed or not."""
    done = (
        reviewed.select("document_id")
        .join(latest.select("document_id"), "document_id", "left_semi")
        .distinct()
        .select(F.col("document_id").alias("id"), F.lit(True).alias("reviewed"))
    )
    hit = F.coalesce("reviewed", F.lit(False))
    return (
        documents.join(done, "id", "left")
        .withColumn("status", F.when(hit, "approved").otherwise(F.col("status")))
        .withColumn("confidence", F.when(hit, F.lit(1.0)).otherwise(F.col("confidence")))
        .drop("reviewed")
    )


def type_correction(original_is_number: Column, entered: Column) -> Column:
    """What an edited form value means, as the text to store: blank is null; where the original
    value is a number, what a browser reads as one is written the way a double prints, and an
    endless one is null, as JSON has none; other text stays as it is."""
    text = F.regexp_replace(
        entered, rf"\A{FORM_SPACE}+|(?<!{FORM_SPACE}){FORM_SPACE}+\z", ""
    )
    number = F.when(original_is_number, form_number(text))
    finite = F.when(F.abs(number) < float("inf"), number.cast("string"))
    return F.when(text != "", F.when(number.isNotNull(), finite).otherwise(text))


def status_counts(documents: DataFrame) -> DataFrame:
    return (
        documents.groupBy("status")
        .agg(F.count("*").alias("n_documents"))
        .withColumn("is_terminal", F.col("status").isin(*TERMINAL_STATUSES))
    )

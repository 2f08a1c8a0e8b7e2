"""Model answers to typed records, and records to and from field rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerproof.config import (
    ALL_FIELDS,
    DATE_FIELDS,
    DEFAULTS,
    NUMBER_FIELDS,
    Settings,
)
from ledgerproof.functions import coerce as c
from ledgerproof.functions.text import SPACE, let
from ledgerproof.schemas import HINT, ISSUE, LINE_ITEM

WRAPPER = "struct<value:variant,page_no:variant,source_text:variant>"
ITEM_FIELDS = ("description", "quantity", "unit_price", "amount")
ITEM_PARTS = "struct<" + ",".join(f"{n}:variant" for n in ITEM_FIELDS) + ">"

# The type of items that hold none but the four parts: text or null, and numbers or null.
_PLAIN_NUMBER = r"(BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9]+,[0-9]+\)|VOID)"
PLAIN_ITEMS = (
    rf"\AARRAY<OBJECT<(amount: {_PLAIN_NUMBER}, )?description: (STRING|VOID)"
    rf"(, quantity: {_PLAIN_NUMBER})?(, unit_price: {_PLAIN_NUMBER})?>>\z"
)


def _plain_answer() -> str:
    """JSON text of a record from `supplier` on, with its keys in field order, each at most once, and
    values of the type they are wanted in, or null; strings hold no escapes, and numbers are short
    enough to be exact.

    Such text says the same to any reader of JSON. Repeated parts are possessive, so that long texts
    need no deep stack.
    """
    blank = r"[ \t\r\n]*+"
    text = r'(?:"[^"\\\x00-\x1f]*+"|null)'
    number = r"(?:(?:-?[1-9][0-9]{0,14}|0)(?:\.[0-9]{1,15})?(?:[eE][+-]?[0-9]{1,2})?|null)"
    page = r"(?:[1-9][0-9]{0,8}|0|null)"

    def entry(name, value):
        return rf'"{name}"{blank}:{blank}{value}{blank}'

    def rest(*entries):
        return "".join(rf"(?:,{blank}{x})?+" for x in entries)

    def cell(f):
        value = entry("value", number if f in NUMBER_FIELDS else text)
        return rf"\{{{blank}{value}{rest(entry('page_no', page), entry('source_text', text))}\}}"

    first, *others = [entry(n, text if n == "description" else number) for n in ITEM_FIELDS]
    item = rf"\{{{blank}{first}{rest(*others)}\}}{blank}"
    items = rf"\[{blank}(?:{item}(?:,{blank}{item})*+)?+\]"
    first, *others = [entry(f, cell(f)) for f in ALL_FIELDS]
    return rf"\A{blank}\{{{blank}{first}{rest(*others, entry('line_items', items))}\}}{blank}\z"


PLAIN_ANSWER = _plain_answer()
PLAIN_PARTS = ",".join(
    f"{f} struct<value:{'double' if f in NUMBER_FIELDS else 'string'},page_no:int,source_text:string>"
    for f in ALL_FIELDS
) + f",line_items array<{LINE_ITEM}>"


def parse_answers(extractions: DataFrame, raw: str = "raw") -> DataFrame:
    """Add `answer`, the VARIANT of the JSON object in `raw`; NULL for anything else."""
    is_object = F.col(raw).rlike(r"^\s*\{")
    return extractions.withColumn("answer", F.when(is_object, F.try_parse_json(raw)))


def _page_number(v: Column) -> Column:
    """An integer, or a float or boolean equal to one; anything else is no page."""

    def whole(x):
        fits = (x == F.floor(x)) & x.between(-2147483648, 2147483647)
        return F.when(fits, x.cast("int"))

    t = c.variant_type(v)
    return (
        F.when(t == "BIGINT", F.try_variant_get(v, "$", "int"))
        .when(c.is_numeric(t), let(F.try_variant_get(v, "$", "double"), whole))
        .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int"))
    )


def _field_names() -> Column:
    return F.array(*[F.lit(f) for f in ALL_FIELDS])


def unwrap_grounded(answers: DataFrame) -> DataFrame:
    """Split every `{value, page_no, source_text}` into a value and a hint.

    Adds `value_<field>` (VARIANT), `vtype_<field>`, and `hints`, one struct per
    field in field order. A field that is not wrapped like that gets a null
    value and null hints. Each step is a flat list of columns rather than a
    lambda over the fields, so that it runs as generated code.
    """
    wrapped = answers.withColumns({
        f"cell_{f}": F.try_variant_get("answer", f"$.{f}", WRAPPER) for f in ALL_FIELDS
    })
    parts = {}
    for f in ALL_FIELDS:
        cell = F.col(f"cell_{f}")
        there = cell["value"].isNotNull()
        parts[f"value_{f}"] = cell["value"]
        parts[f"vtype_{f}"] = c.variant_type(cell["value"])
        parts[f"page_{f}"] = F.when(there, _page_number(cell["page_no"]))
        parts[f"source_{f}"] = F.when(
            there, c.as_text(cell["source_text"], c.variant_type(cell["source_text"]))
        )
    split = wrapped.withColumns(parts)
    hints = F.array(*[
        F.struct(
            F.lit(f).alias("field"), F.col(f"page_{f}").alias("page_no"),
            F.col(f"source_{f}").alias("source_text"),
        ).cast(HINT)
        for f in ALL_FIELDS
    ])
    return split.withColumn("hints", hints).drop(
        *[f"{part}_{f}" for f in ALL_FIELDS for part in ("cell", "page", "source")]
    )


def _item(x: Column) -> Column:
    """One line item from its VARIANT parts; what cannot be read becomes null."""
    def part(name):
        read = c.as_text if name == "description" else c.as_number
        return let(c.variant_type(x[name]), lambda t: read(x[name], t)).alias(name)

    return F.struct(*[part(n) for n in ITEM_FIELDS]).cast(LINE_ITEM)


def _warning(field: Column, value: Column, vtype: Column) -> Column:
    return F.struct(
        F.lit("unparseable_field").alias("rule"),
        F.lit("warning").alias("severity"),
        field.alias("field"),
        F.concat(
            F.lit("Field '"), field, F.lit("' had an invalid value and was dropped: "),
            c.shown(value, vtype),
        ).alias("message"),
    ).cast(ISSUE)


def _read(f: str) -> Column:
    v, t = F.col(f"value_{f}"), F.col(f"vtype_{f}")
    if f in NUMBER_FIELDS:
        return c.as_number(v, t)
    if f in DATE_FIELDS:
        return c.as_date(v, t)
    return c.as_text(v, t)


def coerce_record(unwrapped: DataFrame) -> DataFrame:
    """Build the typed record field by field, dropping what cannot be read.

    Adds `record` (struct of the eight fields and `line_items`), `pre_issues`
    (one `unparseable_field` warning per dropped field) and `build_error`,
    which is set when no record can be built at all: the answer is not a JSON
    object, or its `line_items` is an explicit null.
    """
    typed = unwrapped.withColumns({
        **{f"read_{f}": _read(f) for f in ALL_FIELDS},
        "items_raw": c.variant_at(F.col("answer"), "$.line_items"),
    })
    typed = typed.withColumns({
        "items_null": F.is_variant_null("items_raw"),
        "items_plain": c.variant_type(F.col("items_raw")).rlike(PLAIN_ITEMS),
    })
    # Items whose parts all have the type they are wanted in are read at once; the others part by part.
    typed = typed.withColumns({
        "items_typed": F.when(
            F.col("items_plain"), F.try_variant_get("items_raw", "$", f"array<{LINE_ITEM}>")
        ),
        # An element that is no object becomes a null entry.
        "items_parts": F.when(
            ~F.coalesce("items_plain", F.lit(False)),
            F.try_variant_get("items_raw", "$", f"array<{ITEM_PARTS}>"),
        ),
    })
    parts, whole = F.col("items_parts"), F.col("items_typed")
    typed = typed.withColumn(
        "bad_items",
        F.when(whole.isNotNull(), F.size(F.filter(whole, lambda x: x.isNull())))
        .when(parts.isNotNull(), F.size(F.filter(parts, lambda x: x.isNull())))
        .when(F.col("items_raw").isNull() | F.col("items_null"), F.lit(0))
        .otherwise(F.lit(1)),
    )
    none = F.array().cast(f"array<{LINE_ITEM}>")
    items = (
        F.when(F.col("bad_items") > 0, none).when(whole.isNotNull(), whole)
        .when(parts.isNotNull(), F.transform(parts, _item)).otherwise(none)
    )
    # What was refused, by field; the text of the warnings is rarely needed and
    # written once for all fields to keep the plan small.
    was_refused = [
        c.is_value(F.col(f"vtype_{f}")) & F.col(f"read_{f}").isNull() for f in ALL_FIELDS
    ]
    refused = F.array_compact(F.array(*[
        F.when(
            cond,
            F.struct(
                F.lit(f).alias("field"), F.col(f"value_{f}").alias("value"),
                F.col(f"vtype_{f}").alias("vtype"),
            ),
        )
        for f, cond in zip(ALL_FIELDS, was_refused)
    ]))
    refused_items = F.array_repeat(
        F.struct(
            F.lit("line_items").alias("field"), F.col("items_raw").alias("value"),
            c.variant_type(F.col("items_raw")).alias("vtype"),
        ),
        F.col("bad_items"),
    )
    any_refused = F.col("bad_items") > 0
    for cond in was_refused:
        any_refused = any_refused | cond
    # Lambdas don't run as generated code, so the list is only made where it has entries.
    warnings = F.when(any_refused, F.transform(
        F.when(F.col("bad_items") > 0, F.concat(refused, refused_items)).otherwise(refused),
        lambda x: _warning(x["field"], x["value"], x["vtype"]),
    )).otherwise(F.array().cast(f"array<{ISSUE}>"))
    # The items get a column of their own first: inside the struct, each later
    # use of `record.line_items` would evaluate them again.
    return typed.withColumn("line_items", items).withColumns({
        "record": F.struct(*[F.col(f"read_{f}").alias(f) for f in ALL_FIELDS], "line_items"),
        "pre_issues": warnings,
        "build_error": F.when(
            F.col("answer").isNull(), F.lit("answer is not a JSON object")
        ).when(F.col("items_null"), F.lit("line_items is null")),
    }).drop(
        *[f"{part}_{f}" for f in ALL_FIELDS for part in ("value", "vtype", "read")],
        "items_raw", "items_null", "items_plain", "items_typed", "items_parts", "bad_items",
        "line_items",
    )


def build_records(extractions: DataFrame) -> DataFrame:
    """JSON answers to `record`, `hints`, `pre_issues` and `build_error`.

    A plain answer (see `_plain_answer`) is read at once; the others go part by part through
    `unwrap_grounded` and `coerce_record`, which find no answer in the rows read before.
    """
    rows = _read_plain(extractions)
    rows = rows.withColumn("raw_left", F.when(F.col("plain_items").isNull(), F.col("raw")))
    rows = coerce_record(unwrap_grounded(parse_answers(rows, "raw_left")))
    plain = F.col("plain_items").isNotNull()

    def of(f):
        return F.col(f"plain_{f}") if f in DATE_FIELDS else F.col(f"plain.{f}.value")

    record = F.struct(*[of(f).alias(f) for f in ALL_FIELDS], F.col("plain_items").alias("line_items"))
    hints = F.array(*[
        F.struct(
            F.lit(f).alias("field"), F.col(f"plain.{f}.page_no").alias("page_no"),
            F.col(f"plain.{f}.source_text").alias("source_text"),
        ).cast(HINT)
        for f in ALL_FIELDS
    ])
    return rows.withColumns({
        "record": F.when(plain, record).otherwise(F.col("record")),
        "hints": F.when(plain, hints).otherwise(F.col("hints")),
        "build_error": F.when(~plain, F.col("build_error")),
    }).drop("answer", "raw_left", "plain", "plain_items", *[f"plain_{f}" for f in DATE_FIELDS])


def _read_plain(extractions: DataFrame) -> DataFrame:
    """Add `plain`, the typed parts of a plain answer, its dates, and `plain_items`, which is null
    unless all of it could be read."""
    is_plain = F.col("raw").rlike(PLAIN_ANSWER) & F.is_valid_utf8("raw")
    rows = extractions.withColumn("plain", F.from_json(F.when(is_plain, F.col("raw")), PLAIN_PARTS))
    rows = rows.withColumns({
        f"plain_{f}": c.date_from_text(F.col(f"plain.{f}.value")) for f in DATE_FIELDS
    })
    read = F.col("plain").isNotNull()
    for f in DATE_FIELDS:
        read = read & (F.col(f"plain_{f}").isNotNull() | F.col(f"plain.{f}.value").isNull())
    none = F.array().cast(f"array<{LINE_ITEM}>")
    return rows.withColumn("plain_items", F.when(read, F.coalesce("plain.line_items", none)))


def field_values_long(records: DataFrame) -> DataFrame:
    """One row per extraction and field, with its location, plus `line_items`.

    Needs `extraction_id`, `record` and `matches` (see `ground`). `value` holds
    plain text; numbers keep the text of the double. Only a grounded field has
    a page, box and source text.
    """
    def match_of(f):
        return F.get(F.filter("matches", lambda m: m["field"] == f), F.lit(0))

    rows = []
    for f in ALL_FIELDS:
        m = match_of(f)
        rows.append(
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"record.{f}").cast("string").alias("value"),
                m["page_no"].alias("page_no"),
                m["bbox"].alias("bbox"),
                m["source_text"].alias("source_text"),
            )
        )
    rows.append(
        F.struct(
            F.lit("line_items").alias("field"),
            F.to_json("record.line_items", {"ignoreNullFields": "false"}).alias("value"),
            F.lit(None).cast("int").alias("page_no"),
            F.lit(None).cast("array<double>").alias("bbox"),
            F.lit(None).cast("string").alias("source_text"),
        )
    )
    return records.select("extraction_id", F.inline(F.array(*rows)))


def field_values_wide(field_values: DataFrame) -> DataFrame:
    """One row per extraction with a column per field."""
    fields = [*ALL_FIELDS, "line_items"]
    return field_values.groupBy("extraction_id").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    )


def model_cost(calls: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add `cost_usd` from `tier`, `input_tokens` and `output_tokens`; null for an unknown tier."""
    tier = F.col("tier")
    price_in = F.when(tier == "strong", settings.strong_price_in).when(
        tier == "cheap", settings.cheap_price_in)
    price_out = F.when(tier == "strong", settings.strong_price_out).when(
        tier == "cheap", settings.cheap_price_out)
    tokens_in = F.coalesce("input_tokens", F.lit(0))
    tokens_out = F.coalesce("output_tokens", F.lit(0))
    return calls.withColumn(
        "cost_usd", tokens_in / 1_000_000 * price_in + tokens_out / 1_000_000 * price_out
    )


def escalation_reasons(
    issues: Column, ungrounded: Column, disagreed: Column
) -> Column:
    """What the stronger model is told: errors, then unfound, then disputed fields."""
    errors = F.transform(
        F.filter(issues, lambda i: i["severity"] == "error"), lambda i: i["message"]
    )
    return F.concat(
        errors,
        F.array_compact(F.array(
            F.when(
                F.size(ungrounded) > 0,
                F.concat(
                    F.lit("Could not verify these fields actually appear in the document text "
                          "as claimed: "),
                    F.array_join(ungrounded, ", "),
                ),
            ),
            F.when(
                F.size(disagreed) > 0,
                F.concat(
                    F.lit("An independent review flagged these fields as not matching their "
                          "cited source text: "),
                    F.array_join(disagreed, ", "),
                ),
            ),
        )),
    )


def review_normalize(reviews: DataFrame) -> DataFrame:
    """Add `agreements`, a map field -> true, false or null, from JSON `review`."""

    # Flat columns rather than a lambda over the fields, so that they run as generated code.
    parsed = reviews.withColumn("parsed_review", F.try_parse_json("review"))
    parsed = parsed.withColumns({
        f"agrees_{f}": c.variant_at(F.col("parsed_review"), f"$.{f}.agrees") for f in ALL_FIELDS
    })
    agreements = F.array(*[
        F.when(
            c.variant_type(F.col(f"agrees_{f}")) == "BOOLEAN",
            F.try_variant_get(f"agrees_{f}", "$", "boolean"),
        )
        for f in ALL_FIELDS
    ])
    return parsed.withColumn("agreements", F.map_from_arrays(_field_names(), agreements)).drop(
        "parsed_review", *[f"agrees_{f}" for f in ALL_FIELDS]
    )


# The labels the rule-based extractor understands, as patterns
# whose first group is the value. They describe our own fixture layout.
LABELS = {
    "supplier": rf"^(?:Supplier|Vendor|From):{SPACE}*(.+)$",
    "invoice_number": rf"^Invoice(?: (?:No|Number|#))?\.?:?{SPACE}+(?!Date)([A-Z][A-Z0-9]*-[0-9-]+)$",
    "invoice_date": rf"^Invoice Date:{SPACE}*([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})$",
    "due_date": rf"^Due Date:{SPACE}*([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})$",
    "currency": rf"^Currency:{SPACE}*(.+)$",
    "subtotal": rf"^Subtotal:{SPACE}*([0-9]+(?:\.[0-9]+)?)$",
    "tax": rf"^Tax:{SPACE}*([0-9]+(?:\.[0-9]+)?)$",
    "total": rf"^Total:{SPACE}*([0-9]+(?:\.[0-9]+)?)$",
}


def label_extract(pages: DataFrame) -> DataFrame:
    """A rule-based stand-in for the model: `Label: value` lines to an answer.

    The first match by page and line wins per field; the value's own text is
    the source text. Gives `document_id, raw` in the grounded JSON shape, so the
    rest of the flow can run without any model. Matching happens per page; only
    each page's first match per field reaches the shuffle.
    """
    lines = F.transform(
        F.split("text", "\n"), lambda line: F.regexp_replace(line, rf"{SPACE}+\z", "")
    )

    def first(f):
        hit = F.get(
            F.filter(
                F.transform(F.col("lines"), lambda x: F.regexp_extract(x, LABELS[f], 1)),
                lambda m: m != "",
            ),
            F.lit(0),
        )
        return F.when(
            hit.isNotNull(), F.struct(F.col("page_no").alias("page_no"), hit.alias("text"))
        ).alias(f)

    hits = pages.select("document_id", "page_no", lines.alias("lines")).select(
        "document_id", *[first(f) for f in ALL_FIELDS]
    )
    best = hits.groupBy("document_id").agg(*[F.min(f).alias(f) for f in ALL_FIELDS])

    def wrapped(f):
        text = F.col(f"{f}.text")
        value = text.try_cast("double") if f in NUMBER_FIELDS else text
        return F.struct(
            value.alias("value"), F.col(f"{f}.page_no").alias("page_no"), text.alias("source_text")
        ).alias(f)

    answer = F.struct(
        *[wrapped(f) for f in ALL_FIELDS],
        F.array().cast(f"array<{LINE_ITEM}>").alias("line_items"),
    )
    return best.select(
        "document_id", F.to_json(answer, {"ignoreNullFields": "false"}).alias("raw")
    )

import datetime
import json

import pytest
from pyspark.sql import functions as F

from ledgerproof.config import ALL_FIELDS
from ledgerproof.operators import record


def wrap(value, page=1, source="x"):
    return {"value": value, "page_no": page, "source_text": source}


def build(spark, *raws):
    rows = [(str(i), r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(raws)]
    df = spark.createDataFrame(rows, "extraction_id string, raw string")
    out = record.build_records(df).orderBy(F.col("extraction_id").cast("int")).collect()
    assert len(out) == len(raws)
    return out


CLEAN = {
    "supplier": wrap("Acme Co"), "invoice_number": wrap("INV-1"),
    "invoice_date": wrap("2026-01-01"), "due_date": wrap("2026-01-31"),
    "currency": wrap("USD"), "subtotal": wrap(100), "tax": wrap(10.0), "total": wrap("110"),
    "line_items": [{"description": "Widget", "quantity": 1, "unit_price": 100, "amount": 100.0}],
}


def test_clean_answer(spark):
    (row,) = build(spark, CLEAN)
    assert row.build_error is None and row.pre_issues == []
    assert row.record.supplier == "Acme Co"
    assert row.record.invoice_date == datetime.date(2026, 1, 1)
    assert (row.record.subtotal, row.record.tax, row.record.total) == (100.0, 10.0, 110.0)
    assert row.record.line_items[0].asDict() == {
        "description": "Widget", "quantity": 1.0, "unit_price": 100.0, "amount": 100.0}
    assert [h.field for h in row.hints] == list(ALL_FIELDS)


def test_bad_dates_warn_and_keep_the_rest(spark):
    (row,) = build(spark, {**CLEAN, "invoice_date": wrap("03/04"), "due_date": wrap("not a date")})
    assert row.record.invoice_date is None and row.record.due_date is None
    assert row.record.total == 110.0
    assert [(i.rule, i.severity, i.field) for i in row.pre_issues] == [
        ("unparseable_field", "warning", "invoice_date"),
        ("unparseable_field", "warning", "due_date")]
    assert row.pre_issues[0].message.endswith("was dropped: '03/04'")


def test_wrapper_shapes(spark):
    rows = build(
        spark,
        {**CLEAN, "supplier": "Acme Co"},
        {**CLEAN, "supplier": {"page_no": 1, "source_text": "Acme"}},
        {**CLEAN, "supplier": {"value": None, "page_no": 1, "source_text": "Acme"}},
        {k: v for k, v in CLEAN.items() if k != "supplier"},
        {**CLEAN, "supplier": {"value": "A", "page_no": "1", "source_text": 7}},
        {**CLEAN, "supplier": {"value": "A", "page_no": 2.0, "source_text": "A"}},
        {**CLEAN, "supplier": {"value": "A", "page_no": 1.5, "source_text": "A"}},
        {**CLEAN, "supplier": [1]},
    )
    assert [r.record.supplier for r in rows] == [None, None, None, None, "A", "A", "A", None]
    hints = [(r.hints[0].page_no, r.hints[0].source_text) for r in rows]
    assert hints == [(None, None), (None, None), (1, "Acme"), (None, None), (None, None),
                     (2, "A"), (None, "A"), (None, None)]
    assert all(r.pre_issues == [] for r in rows)


def test_line_items(spark):
    rows = build(
        spark,
        {**CLEAN, "line_items": [{"description": 5, "quantity": "a lot", "amount": "2"}]},
        {**CLEAN, "line_items": [{"amount": 1}, "x", None, 3]},
        {**CLEAN, "line_items": "n/a"},
        {**CLEAN, "line_items": {}},
        {**CLEAN, "line_items": None},
        {k: v for k, v in CLEAN.items() if k != "line_items"},
        "not json",
        "[1]",
    )
    first = rows[0].record.line_items[0]
    assert (first.description, first.quantity, first.amount) == (None, None, 2.0)
    assert [len(r.pre_issues) for r in rows[:6]] == [0, 3, 1, 1, 0, 0]
    assert [len(r.record.line_items) for r in rows[:4]] == [1, 0, 0, 0]
    assert [r.build_error is not None for r in rows] == [False] * 4 + [True, False, True, True]


NUMBERS = [
    ("1e3", 1000.0), (" 10.5 ", 10.5), ("1_000", 1000.0), ("1__0", None), ("_1", None), ("1_", None),
    ("10d", None), (".5", 0.5), ("5.", 5.0), ("+5", 5.0), (" 10 ", 10.0), ("1_0.5_0", 10.5),
    ("0x10", None), ("1 0", None), ("--1", None), ("", None), ("1,000.00", None), ("1E+5", 100000.0),
    ("-Infinity", float("-inf")), (True, 1.0), (False, 0.0), (7, 7.0), ([1], None), ({"a": 1}, None),
]
DATES = [
    ("2026-01-15", "2026-01-15"), ("2026-01-15T00:00:00", "2026-01-15"),
    ("2026-01-15 00:00:00", "2026-01-15"), ("2026-01-15T00:00:00Z", "2026-01-15"),
    ("2026-01-15T00:00:00-0500", "2026-01-15"), ("2026-01-15T10:00:00", None), ("2026-1-15", None),
    ("2026", None), (" 2026-01-15 ", None), ("2026-02-30", None), ("0000-01-01", None),
    ("1699920000", "2023-11-14"), (1699920000, "2023-11-14"), (1699920000000, "2023-11-14"),
    (-86400, "1969-12-31"), (1.5, None), (86400.0, "1970-01-02"), (True, None), ("1e5", None),
    ("+86400", "1970-01-02"), (20000000000, None),
]


def test_number_coercion(spark):
    rows = build(spark, *[{**CLEAN, "total": wrap(v)} for v, _ in NUMBERS])
    assert [r.record.total for r in rows] == [want for _, want in NUMBERS]
    assert [len(r.pre_issues) for r in rows] == [int(w is None) for _, w in NUMBERS]
    (nan,) = build(spark, {**CLEAN, "total": wrap("nan")})
    assert nan.record.total != nan.record.total


def test_date_coercion(spark):
    rows = build(spark, *[{**CLEAN, "invoice_date": wrap(v)} for v, _ in DATES])
    got = [r.record.invoice_date and r.record.invoice_date.isoformat() for r in rows]
    assert got == [want for _, want in DATES]
    assert [len(r.pre_issues) for r in rows] == [int(w is None) for _, w in DATES]


@pytest.mark.parametrize("value", [123, True, 1.5, ["a"]])
def test_text_fields_take_text_only(spark, value):
    (row,) = build(spark, {**CLEAN, "supplier": wrap(value)})
    assert row.record.supplier is None and len(row.pre_issues) == 1


def test_label_extract_builds_a_grounded_answer(spark):
    text = "Supplier: Acme Co\nInvoice INV-1001\nInvoice Date: 2026-01-15\nTax: 20.00\nTotal: 270.00  "
    pages = spark.createDataFrame(
        [("d", 2, "Total: 1.00\nCurrency: USD"), ("d", 1, text)],
        "document_id string, page_no int, text string",
    )
    (row,) = record.build_records(record.label_extract(pages)).collect()
    assert (row.record.supplier, row.record.invoice_number) == ("Acme Co", "INV-1001")
    assert (row.record.total, row.record.tax, row.record.currency) == (270.0, 20.0, "USD")
    assert {h.field: h.page_no for h in row.hints}["currency"] == 2

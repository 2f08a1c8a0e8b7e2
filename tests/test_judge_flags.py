"""The flags that stand in for records and matches, and items read at once."""

import datetime
import json

from pyspark.sql import functions as F

from ledgerproof.config import ALL_FIELDS, DATE_FIELDS, NUMBER_FIELDS
from ledgerproof.functions.issues import given
from ledgerproof.operators import evaluate, ground, record
from ledgerproof.plans import trust as plan
from ledgerproof.schemas import HINT, WORD


def _words(text):
    return [(w, [10.0 * i, 0.0, 10.0 * i + 5, 9.0]) for i, w in enumerate(text.split(" "))]


def _pages(spark):
    return spark.createDataFrame(
        [("d", 1, _words("Acme Corp INV-1 2024-01-01")), ("d", 2, _words("USD 10.00 1.00 11.00"))],
        f"document_id string, page_no int, words array<{WORD}>",
    )


def test_bits_name_the_fields_of_the_matches(spark):
    first = [(f, 1 + i % 2, t) for i, (f, t) in enumerate(zip(
        reversed(ALL_FIELDS), ("inv-1", "10.00", "acme corp", "absent", "2024-01-01", "usd", None, "11.00")
    ))]
    rows = [("a", "d", first), ("b", "d", first + [("invoice_number", 1, "corp inv-1"), ("other", 2, "1.00")]),
            ("c", "d", [("tax", 3, "1.00")])]
    records = spark.createDataFrame(
        rows, f"extraction_id string, document_id string, hints array<{HINT}>"
    )
    want = {
        r.extraction_id: sum(1 << ALL_FIELDS.index(f) for f in {m.field for m in r.matches} & set(ALL_FIELDS))
        for r in ground.matches_of(records, _pages(spark)).collect()
    }
    got = {r.extraction_id: r.found for r in ground.found_of(records, _pages(spark)).collect()}
    assert got == want and got["a"] > 0 and got["a"] != got["b"]


def test_flags_judge_as_records_do(spark):
    def answer(**change):
        cells = {"supplier": ("Acme Corp", 1, "Acme Corp"), "invoice_number": ("INV-1", 1, "INV-1"),
                 "invoice_date": ("2024-01-01", 1, "2024-01-01"), "currency": ("USD", 2, "USD"),
                 "subtotal": (10.0, 2, "10.00"), "tax": (1.0, 2, "1.00"), "total": (11.0, 2, "11.00")}
        cells |= change
        return json.dumps({f: dict(zip(("value", "page_no", "source_text"), c)) for f, c in cells.items()})

    raws = [answer(), answer(total=(12.0, 2, "11.00")), answer(supplier=("Acme", 1, "no such")), "{}"]
    reviews = ['{"total": {"agrees": false}}', None, '{"total": 3, "tax": {"agrees": true}}', "[1]"]
    built = record.build_records(spark.createDataFrame(
        [(f"{i}{j}", "d", "t", 1, raw, review)
         for i, raw in enumerate(raws) for j, review in enumerate(reviews)],
        "extraction_id string, document_id string, tenant_id string, attempt_no int, raw string, review string",
    ))
    columns = ("extraction_id", "suspect", "reasons", "signals")
    whole = plan.check_records(built, _pages(spark)).select(*columns).orderBy("extraction_id").collect()
    flags = plan.judge_flags(built, _pages(spark)).select(*columns).orderBy("extraction_id").collect()
    assert flags == whole and len({r.suspect for r in whole}) == 2


def test_items_are_the_same_read_at_once_or_by_part(spark):
    lists = [
        '[{"description":"a","quantity":1,"unit_price":null,"amount":2.50}]',
        '[{"amount":1e2},{"description":null,"amount":3}]',
        '[{"description":"a","quantity":"1_0","unit_price":true,"amount":"x","more":1}]',
        '[{"description":"a","amount":1},null]', '[{"description":"a"},7]', "[]", '"n/a"', "null",
        '[{"description":5,"amount":1}]',
    ]
    rows = spark.createDataFrame(
        [(str(i), f'{{"line_items":{x}}}') for i, x in enumerate(lists)], "extraction_id string, raw string"
    )
    got = record.build_records(rows).orderBy("extraction_id").collect()
    assert [[tuple(i) for i in r.record.line_items] for r in got] == [
        [("a", 1.0, None, 2.5)], [(None, None, None, 100.0), (None, None, None, 3.0)],
        [("a", 10.0, 1.0, None)], [], [], [], [], [], [(None, None, None, 1.0)],
    ]
    assert [len(r.pre_issues) for r in got] == [0, 0, 0, 1, 1, 0, 1, 0, 0]
    assert [r.build_error for r in got] == [None] * 7 + ["line_items is null", None]


def test_given_drops_nulls_and_keeps_the_order(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (named_struct('a', 1), NULL, named_struct('a', 3)), (NULL, NULL, NULL) AS t(x, y, z)"
    )
    got = rows.select(given(F.col("x"), F.col("y"), F.col("z")).alias("g")).collect()
    assert [[s.a for s in r.g] for r in got] == [[1, 3], []]


def test_dates_are_matched_without_being_written_as_text(spark):
    fields = ", ".join(f"{f} {'double' if f in NUMBER_FIELDS else 'date' if f in DATE_FIELDS else 'string'}"
                       for f in ALL_FIELDS)
    day, other = datetime.date(2024, 1, 2), datetime.date(2024, 1, 3)
    kinds = {f: (1.0, 2.0) if f in NUMBER_FIELDS else (day, other) if f in DATE_FIELDS else ("Ab", "b")
             for f in ALL_FIELDS}
    sides = [[kinds[f][0] for f in ALL_FIELDS], [kinds[f][1] for f in ALL_FIELDS], [None] * len(ALL_FIELDS)]
    labels = spark.createDataFrame([(f"s{i}", *x) for i, x in enumerate(sides)], f"sample string, {fields}")
    records = spark.createDataFrame(
        [(f"s{i}", tuple(x)) for i in range(3) for x in sides],
        f"sample string, record struct<{fields.replace(' ', ':').replace(',:', ',')}>")
    rows = evaluate.score_records(labels, records)
    assert sorted(tuple(r.ok) for r in rows.collect()) == [(0,) * 8] * 6 + [(1,) * 8] * 3
    plan = rows.select("ok")._jdf.queryExecution().optimizedPlan().toString()
    assert "as string)" not in plan

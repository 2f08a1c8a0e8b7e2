"""Plain answers are read at once, and pages searched in one pass, with the results of the general steps."""

import datetime
import json

from ledgerproof.catalog import checks
from ledgerproof.catalog.core import Tables
from ledgerproof.config import ALL_FIELDS, NUMBER_FIELDS
from ledgerproof.operators import ground, record
from ledgerproof.schemas import HINT, WORD


def _cell(f):
    value = 1.25 if f in NUMBER_FIELDS else "2024-01-01"
    return {"value": value, "page_no": 1, "source_text": f}


def test_plain_answers_equal_those_read_part_by_part(spark):
    whole = {f: _cell(f) for f in ALL_FIELDS} | {
        "line_items": [{"description": "a", "quantity": 1, "unit_price": None, "amount": 2.5}]
    }
    plain = [whole, {"supplier": _cell("supplier"), "total": {"value": 1e-7}},
             {"supplier": _cell("supplier"), "tax": {"value": None, "source_text": None}},
             {"supplier": {"value": "", "page_no": 0}, "line_items": []}]
    odd = [{"supplier": {"value": 5}}, {"due_date": {"value": "03/04"}}, {"total": {"value": " 1 "}},
           {"line_items": None}, {"line_items": [None]}, {"supplier": "x"}, {"total": {"value": -0.0}},
           {"supplier": {"value": "a", "page_no": 2147483648}}, {}]
    texts = [json.dumps(x) for x in plain + odd] + [
        json.dumps(whole, indent=1), '{"tax":{"value":1},"tax":{"value":2}}', '{"tax":{"value":1}} x', None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "extraction_id int, raw string")
    columns = ("extraction_id", "record", "hints", "pre_issues", "build_error")
    got = record.build_records(rows).select(*columns).orderBy("extraction_id").collect()
    parts = record.coerce_record(record.unwrap_grounded(record.parse_answers(rows)))
    assert got == parts.select(*columns).orderBy("extraction_id").collect()
    at_once = record._read_plain(rows).where("plain_items IS NOT NULL").select("extraction_id").collect()
    assert {r.extraction_id for r in at_once} == {0, 1, 2, 3, len(plain + odd)}


def test_one_pass_finds_what_the_join_by_page_finds(spark):
    box = [0.0, 0.0, 1.0, 1.0]
    pages = spark.createDataFrame([
        ("d", 1, [("Acme", box), ("Corp", box), ("11.00", None)]), ("d", 1, [("INV-1", box)]),
        ("d", 2, [("Due  on", box), ("", box), ("Monday", box)]), ("d", 3, None), ("d", None, [("x", box)]),
        (None, 1, [("acme", box)]),
    ], f"document_id string, page_no int, words array<{WORD}>")
    hints = [("supplier", 1, " acme  CORP "), ("invoice_number", 1, "inv-1"), ("invoice_date", 1, "corp 11.00"),
             ("due_date", 2, "due on monday"), ("currency", 3, "x"), ("subtotal", None, "x"),
             ("tax", 2, "absent"), ("total", 1, "11.00")]
    more = [*hints, ("tax", 2, "monday"), ("other", 1, "acme")]
    records = spark.createDataFrame(
        [("a", "d", hints), ("b", "d", more), ("c", None, hints), ("e", "none", hints), ("f", "d", None),
         ("g", "d", hints[:1]), ("g", "d", hints[:2])],
        f"extraction_id string, document_id string, hints array<{HINT}>",
    )
    want = {r.extraction_id: r.found for r in ground.found_of(records, pages).collect()}
    got = ground.with_found(records, pages).select("extraction_id", "found").collect()
    assert len(got) == 7 and [r.found for r in got] == [want.get(r.extraction_id, 0) for r in got]
    assert want["a"] == 0b1111 and want["b"] == 0b1001111


def test_final_attempts_parse_in_the_same_job(spark, tmp_path):
    day = datetime.datetime(2026, 1, 2)
    frames = {
        "orders": spark.createDataFrame(
            [(k, k % 3, day, 10.0) for k in range(1, 31)],
            "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_totalprice double"),
        "lineitem": spark.createDataFrame(
            [(k, 1, 10.0, 0.1, "ANR"[k % 3], day) for k in range(1, 31)],
            "l_orderkey bigint, l_suppkey bigint, l_extendedprice double, l_tax double, "
            "l_returnflag string, l_shipdate timestamp"),
        "supplier": spark.createDataFrame(
            [(1, "Acme", 5.0)], "s_suppkey bigint, s_name string, s_acctbal double"),
    }
    for name, df in frames.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    df = checks.final_attempt(Tables(spark, str(tmp_path)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # Once for the answers and once for the reviews.
    assert plan.count("parseJson") == 2 and df.count() == 30

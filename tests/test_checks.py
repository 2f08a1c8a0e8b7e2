import datetime
import json

import pytest
from pyspark.sql import functions as F

from ledgerproof.config import ALL_FIELDS
from ledgerproof.operators import cross, rules
from ledgerproof.plans import infer, trust as plan
from ledgerproof.schemas import LINE_ITEM, WORD

D = datetime.date
CLEAN = {
    "supplier": "Acme Co", "invoice_number": "INV-1", "invoice_date": D(2026, 1, 1),
    "due_date": D(2026, 1, 31), "currency": "USD", "subtotal": 100.0, "tax": 10.0, "total": 110.0,
    "line_items": [("Widget", 1.0, 100.0, 100.0)],
}
SCHEMA = ("record struct<supplier:string,invoice_number:string,invoice_date:date,due_date:date,"
          f"currency:string,subtotal:double,tax:double,total:double,line_items:array<{LINE_ITEM}>>")
NAN = float("nan")


def issues_of(spark, **change):
    row = {**CLEAN, **change}
    df = spark.createDataFrame([(tuple(row[f] for f in (*ALL_FIELDS, "line_items")),)], SCHEMA)
    return rules.validate_records(df).collect()[0].rule_issues


@pytest.mark.parametrize("change,want", [
    ({}, []),
    ({"supplier": None}, ["missing_required_field"]),
    ({"supplier": ""}, ["missing_required_field"]),
    ({"supplier": "  "}, []),
    ({"subtotal": 999.0}, ["line_items_subtotal_mismatch", "total_mismatch"]),
    ({"total": 500.0}, ["total_mismatch"]),
    ({"total": 0.0}, ["total_mismatch"]),
    ({"tax": 10.004}, []),
    ({"total": NAN}, []),
    ({"invoice_date": D(2026, 2, 1), "due_date": D(2026, 1, 1)}, ["due_date_before_invoice_date"]),
    ({"currency": "US Dollars"}, ["invalid_currency"]),
    ({"currency": "usd"}, []),
    ({"currency": None}, []),
    ({"currency": ""}, ["invalid_currency"]),
    ({"subtotal": 999.0, "total": 1009.0, "line_items": [("a", 1.0, 1.0, None)]}, []),
    ({"subtotal": None}, []),
])
def test_rules(spark, change, want):
    assert [i.rule for i in issues_of(spark, **change)] == want


def test_rule_messages(spark):
    both = issues_of(spark, subtotal=999.0)
    assert both[0].message == "Line items sum to 100.00 but subtotal is 999.00"
    assert both[1].message == "subtotal (999.00) + tax (10.00) = 1009.00 but total is 110.00"


def test_duplicates_against_brute_force_with_a_hot_key(spark):
    rows = [(f"e{i}", f"d{i:04d}", "t", "Hot " if i % 2 else " HOT", "N1") for i in range(60)]
    rows += [(f"f{i}", f"x{i:04d}", f"t{i % 2}", f"S{i % 5}", f"n{i % 3}") for i in range(40)]
    rows += [("g1", "y1", "t", "  ", "q"), ("g2", "y2", "t", None, "Q"), ("g3", "y3", "t", "", "q")]
    df = spark.createDataFrame(
        rows, "extraction_id string, document_id string, tenant_id string, supplier string, "
        "invoice_number string")

    def key(r):
        return r[2], (r[3] or "").strip().lower(), (r[4] or "").strip().lower()

    want = {}
    for r in rows:
        others = sorted(o[1] for o in rows if key(o) == key(r) and o[1] != r[1])
        if r[3] and r[4] and others:
            want[r[1]] = others[0]
    got = {r.document_id: r.other_id
           for r in cross.duplicate_invoices(df, df).collect()}
    assert got == want
    assert want["y1"] == "y2"


def test_unknown_supplier(spark):
    targets = spark.createDataFrame(
        [("a", "t", " ACME co "), ("b", "u", "Acme Co"), ("c", "t", "Other"), ("d", "t", ""),
         ("e", "t", None)], "document_id string, tenant_id string, supplier string")
    known = spark.createDataFrame([("t", "Acme Co")], "tenant_id string, name string")
    got = cross.unknown_suppliers(targets, known).collect()
    assert sorted(r.document_id for r in got) == ["b", "c"]


LINES = ["Acme Co", "Invoice INV-1001", "Invoice Date: 2026-01-01", "Total: 110.00"]


def page(spark, ids):
    words = [(w, [i * 10.0, 0.0, i * 10.0 + 9, 9.0]) for i, w in enumerate(" ".join(LINES).split())]
    return spark.createDataFrame(
        [(i, 1, words) for i in ids], f"document_id string, page_no int, words array<{WORD}>")


def answer(total=110.0, source="110.00"):
    hints = {"supplier": ("Acme Co",) * 2, "invoice_number": ("INV-1001",) * 2,
             "invoice_date": ("2026-01-01",) * 2, "total": (total, source)}
    raw = {f: {"value": None, "page_no": None, "source_text": None} for f in ALL_FIELDS}
    raw.update({f: {"value": v, "page_no": 1, "source_text": s} for f, (v, s) in hints.items()})
    return json.dumps({**raw, "line_items": []})


def reviewed(agrees=True):
    return json.dumps({f: {"agrees": agrees} for f in ALL_FIELDS})


ANSWERS = ("extraction_id string, document_id string, tenant_id string, attempt_no int, "
           "raw string, review string")


def test_flow(spark):
    answers = spark.createDataFrame([
        ("clean-1", "clean", "t", 1, answer(), reviewed()),
        ("fixed-1", "fixed", "u", 1, answer(source="gone"), reviewed()),
        ("fixed-2", "fixed", "u", 2, answer(), reviewed()),
        ("bad-1", "bad", "v", 1, answer(), reviewed(False)),
        ("bad-2", "bad", "v", 2, answer(source="gone"), reviewed(False)),
        ("wait-1", "wait", "w", 1, answer(source="gone"), reviewed()),
    ], ANSWERS)
    pages = page(spark, ["clean", "fixed", "bad", "wait"])
    suppliers = spark.createDataFrame([("u", "Acme Co")], "tenant_id string, name string")
    got = {r.document_id: r for r in plan.trust_flow(answers, pages, suppliers).collect()}
    assert (got["clean"].status, got["clean"].confidence) == ("approved", 1.0)
    assert got["clean"].unknown_supplier and got["clean"].n_warnings == 1
    assert (got["fixed"].status, got["fixed"].confidence) == ("approved", 0.75)
    assert not got["fixed"].unknown_supplier
    assert (got["bad"].status, got["bad"].confidence) == ("needs_review", 0.25)
    assert got["wait"].pending and got["wait"].status == "extracted"


def test_two_pass_asks_the_strong_model_only_about_doubts(spark, tmp_path):
    requests = spark.createDataFrame(
        [("a", "t", "x"), ("b", "t", "x")],
        "document_id string, tenant_id string, document_text string")
    log = str(tmp_path / "strong")

    def respond(batch, good):
        raws = [answer() if good or d == "a" else answer(source="gone") for d in batch.document_id]
        return batch[["document_id"]].assign(
            raw=raws, review=reviewed(), input_tokens=1_000_000, output_tokens=0, latency_ms=5)

    def strong(batch):
        with open(log, "a") as out:
            out.write("".join(f"{d}:{p}\n" for d, p in zip(batch.document_id, batch.prior_issues)))
        return respond(batch, True)

    both = infer.two_pass(requests, page(spark, ["a", "b"]), lambda x: respond(x, False), strong)
    rows = sorted((r.extraction_id, r.cost_usd) for r in both.collect())
    assert rows == [("a-1", 0.30), ("b-1", 0.30), ("b-2", 1.25)]
    assert both.count() == 3
    lines = open(log).read().splitlines()
    assert len(lines) == 1 and "actually appear" in lines[0] and lines[0].endswith("total")


def test_reviewer_and_classifier_are_calls_of_their_own(spark):
    requests = spark.createDataFrame(
        [("a", "t", "x"), ("b", "t", "x")],
        "document_id string, tenant_id string, document_text string")

    def respond(batch):
        return batch[["document_id"]].assign(
            raw=answer(), review=None, input_tokens=1_000_000, output_tokens=0, latency_ms=5)

    def reviewer(batch):
        assert all("- total: value=" in t and "source_text='" in t for t in batch.review_text)
        return batch[["extraction_id"]].assign(
            review=[reviewed(d == "a") for d in batch.document_id], input_tokens=2_000_000,
            output_tokens=0, latency_ms=7)

    both = infer.two_pass(
        requests, page(spark, ["a", "b"]), respond, respond, reviewer=reviewer).collect()
    rows = sorted((r.extraction_id, r.cost_usd, r.review_cost_usd, r.review_latency_ms) for r in both)
    assert rows == [("a-1", 0.30, 0.60, 7), ("b-1", 0.30, 0.60, 7), ("b-2", 1.25, 2.50, 7)]

    pages = spark.createDataFrame(
        [("a", 1, "one"), ("a", 2, "two"), ("b", 1, "x")], "document_id string, page_no int, text string")

    def classifier(batch):
        assert any("--- Page 2 ---" in t for t in batch.classify_text)
        raw = ['{"pages":[{"page_no":1,"doc_type":" Invoice","confidence":0.9},{"page_no":9}]}' if d == "a"
               else "no json" for d in batch.document_id]
        return batch[["document_id"]].assign(raw=raw, input_tokens=0, output_tokens=0, latency_ms=3)

    found, costs = infer.call_classifier(pages, classifier)
    assert sorted((r.document_id, r.page_no, r.doc_type) for r in found.collect()) == [
        ("a", 1, "invoice"), ("a", 2, "unknown"), ("b", 1, "unknown")]
    assert costs.count() == 2


def test_a_registered_type_is_used(spark):
    from dataclasses import replace

    from ledgerproof import registry

    kind = registry.get("invoice")
    registry.register(replace(kind, name="lenient", validate=lambda rows, settings: rows.withColumn(
        "rule_issues", F.filter("pre_issues", lambda i: F.lit(False)))))
    raw = json.dumps({**json.loads(answer()), "supplier": {"value": None}})
    answers = spark.createDataFrame([("d-1", "d", "t", 1, raw, reviewed())], ANSWERS)
    suppliers = spark.createDataFrame([("t", "Acme Co")], "tenant_id string, name string")
    for name, errors in (("invoice", 1), ("lenient", 0)):
        (row,) = plan.trust_flow(answers, page(spark, ["d"]), suppliers, doc_type=name).collect()
        assert (row.n_errors > 0) == bool(errors)

"""The job fold, corrections and scores against small cases written from the rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerproof.operators import jobs, record, review, trust

START = dt.datetime(2024, 1, 1)


def folded(spark, *events):
    rows = [("d", "extract", START + dt.timedelta(minutes=at), n, kind == "rejected")
            for n, (at, kind) in enumerate(events)]
    failures = spark.createDataFrame(
        rows, "document_id string, stage string, failed_at timestamp, event_id long, rejected boolean")
    row = jobs.fold_failures(failures).first()
    return row.attempts, row.job_status, row.document_status


@pytest.mark.parametrize("events, want", [
    ([(1, "rejected"), (2, "x"), (3, "x")], (0, "failed", "rejected")),
    ([(1, "x"), (2, "x"), (3, "rejected"), (4, "x")], (2, "failed", "rejected")),
    ([(k, "x") for k in range(5)] + [(9, "rejected")], (5, "failed", "failed")),
    ([(k, "x") for k in range(4)], (4, "queued", None)),
    ([(k, "x") for k in range(8)], (5, "failed", "failed")),
    ([(1, "rejected")], (0, "failed", "rejected")),
])
def test_first_end_counts(spark, events, want):
    assert folded(spark, *events) == want


def test_corrections_chain_and_last_wins(spark):
    values = spark.createDataFrame(
        [("e", "total", "5.0", 0.5), ("e", "currency", "EUR", 0.5), ("e", "line_items", "[1]", None)],
        "extraction_id string, field string, value string, confidence double")
    latest = spark.createDataFrame([("d", "e")], "document_id string, extraction_id string")
    asked = spark.createDataFrame([
        ("d", "total", 1, "6.0", "r"), ("d", "total", 2, "6", "r"), ("d", "total", 3, "7.0", "r"),
        ("d", "currency", 4, "EUR", "r"), ("d", "line_items", 5, None, "r"), ("d", "notes", 6, "x", "r"),
        ("x", "total", 7, "1", "r"),
    ], "document_id string, field string, seq bigint, new_value string, reviewer string")
    documents = spark.createDataFrame(
        [("d", "t", "invoice", "needs_review", 0.5), ("x", "t", "invoice", "needs_review", 0.5)],
        "id string, tenant_id string, doc_type string, status string, confidence double")
    new, audit, docs, events = review.submit_corrections(documents, asked, latest, values)
    got = {r.field: (r.value, r.confidence) for r in new.collect()}
    assert got == {"total": ("7.0", 1.0), "currency": ("EUR", 0.5), "line_items": (None, 1.0)}
    chain = [(r.field, r.old_value, r.new_value) for r in audit.orderBy("seq").collect()]
    assert chain == [("total", "5.0", "6.0"), ("total", "6", "7.0"), ("line_items", "[1]", None)]
    assert {r.id: r.status for r in docs.collect()} == {"d": "approved", "x": "needs_review"}
    (event,) = events.collect()
    assert '"total":7.0' in event.payload and '"currency":"EUR"' in event.payload


def test_unknown_tier_has_no_price(spark):
    calls = spark.createDataFrame(
        [("cheap", 1, 1), ("strong", 1, 1), ("other", 1, 1), (None, 1, 1)],
        "tier string, input_tokens long, output_tokens long")
    cost = {r.tier: r.cost_usd for r in record.model_cost(calls).collect()}
    assert cost["other"] is None and cost[None] is None and cost["strong"] > cost["cheap"] > 0


def test_scores_without_and_with_escalation(spark):
    """Not escalated and all good is 1; an escalated document is at 0, 1/4, 1/2 or 3/4."""
    names = ("supplier", "total")
    for escalated in (False, True):
        for first in range(4):
            rows = spark.range(1).select(
                F.lit(escalated).alias("escalated"), F.lit(False).alias("pending"),
                F.array(*[
                    F.struct(F.lit(n).alias("field"), F.lit(True).alias("required"),
                             F.lit(float(s)).alias("sum"))
                    for n, s in zip(names, (first, 3))
                ]).alias("signals"))
            row = trust.decide(rows).first()
            assert row.confidence == (first + (not escalated)) / 4
            assert (row.status == "approved") == (row.confidence >= 0.75)

"""Queries that need the records twice write them, so that answers are parsed and judged once."""

import datetime

import pytest

from ledgerproof.catalog import accuracy, checks, records
from ledgerproof.catalog.core import Tables

DAY = datetime.datetime(2026, 1, 2)


@pytest.fixture
def tables(spark, tmp_path):
    frames = {
        "orders": spark.createDataFrame(
            [(k, k % 3, DAY, 10.0) for k in range(1, 31)],
            "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_totalprice double"),
        "lineitem": spark.createDataFrame(
            [(k, 1 + k % 2, 10.0, 0.1, "ANR"[k % 3], DAY) for k in range(1, 31)],
            "l_orderkey bigint, l_suppkey bigint, l_extendedprice double, l_tax double, "
            "l_returnflag string, l_shipdate timestamp"),
        "supplier": spark.createDataFrame(
            [(1, "Acme", 5.0), (2, "Globex", -5.0)], "s_suppkey bigint, s_name string, s_acctbal double"),
    }
    for name, df in frames.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return Tables(spark, str(tmp_path))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", [checks.grounding_coverage, records.field_values_long])
def test_answers_are_parsed_before_and_not_in_the_plan(tables, query):
    plan = _plan(query(tables))
    assert "parseJson" not in plan and "parse_json" not in plan


@pytest.mark.parametrize("query", [checks.confidence_write_back, checks.extraction_issues])
def test_pages_are_read_for_one_grounding_at_most(tables, query):
    df = query(tables)
    assert _plan(df).count("array_distinct") <= 1
    assert df.count() > 0


@pytest.mark.parametrize("query", [checks.field_confidence, checks.confidence_write_back])
def test_scores_are_written_before_they_become_rows(tables, query):
    df = query(tables)
    assert "try_variant_get" not in _plan(df) and "array_distinct" not in _plan(df)
    assert {"total", "supplier"} <= {r.field for r in df.select("field").distinct().collect()}


def test_scored_records_are_shuffled_once(tables, monkeypatch):
    spark, seen = tables.spark, []
    keep = lambda df, name: seen.append(df) or df
    monkeypatch.setattr(accuracy, "materialise", keep, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = accuracy.attempts(tables)
        plan = (seen or [runs])[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    by_document = [x for x in plan.split("\n") if "Exchange hashpartitioning(document_id" in x]
    assert len(by_document) == 1  # the pages; records and labels are dealt by sample
    assert runs.count() == 30

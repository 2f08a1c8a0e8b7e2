"""Queries run with generated methods that the JVM compiles, also in a session with Spark's defaults."""

import pytest

import __spark_entry__ as spark_entry
from ledgerproof.session import RECOMMENDED

KEY = "spark.sql.codegen.hugeMethodLimit"


@pytest.mark.parametrize("given, want", [("65535", RECOMMENDED[KEY]), ("4000", "4000")])
def test_a_query_sets_the_limit_unless_the_session_has_its_own(spark, tmp_path, given, want):
    spark.createDataFrame([("F", "x")], "o_orderstatus string, o_orderpriority string").selectExpr(
        "1L AS o_orderkey", "1L AS o_custkey", "*", "timestamp'2024-01-01' AS o_orderdate"
    ).write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set(KEY, given)
    try:
        (row,) = spark_entry.queries()["status_counts"](spark, str(tmp_path)).collect()
        assert spark.conf.get(KEY) == want and (row.status, row.n_documents) == ("approved", 1)
    finally:
        spark.conf.set(KEY, RECOMMENDED[KEY])

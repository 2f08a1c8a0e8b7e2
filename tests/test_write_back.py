"""Scores reach field values without a row per score on the driver."""

from ledgerproof.operators import trust


def test_scores_are_joined_as_lists_and_never_broadcast(spark):
    values = spark.createDataFrame(
        [("a", "total", 0.5), ("a", "notes", 0.4), ("b", "total", None), ("c", "total", 0.3),
         (None, "total", 0.2), ("a", None, 0.1), ("a", "total", 0.6)],
        "extraction_id string, field string, confidence double")
    decided = spark.createDataFrame(
        [("a", [("total", 1.0), ("tax", 0.9)]), ("b", [("total", None), ("tax", 0.8)]), ("d", [("total", 0.7)]),
         (None, [("total", 0.6)]), ("a", [("total", 0.25)])],
        "extraction_id string, scores array<struct<field:string,confidence:double>>")
    got = trust.write_back(values, decided)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        ("a", "total", 1.0), ("a", "total", 0.25), ("a", "total", 1.0), ("a", "total", 0.25),
        ("a", "notes", 0.4), ("b", "total", None), ("c", "total", 0.3), (None, "total", 0.2), ("a", None, 0.1),
    ], key=str)
    assert got.columns == ["extraction_id", "field", "confidence"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate inline" not in plan

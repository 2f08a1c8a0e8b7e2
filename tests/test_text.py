import math

from pyspark.sql import functions as F

from ledgerproof.functions import text

SPACES = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isspace()]


def test_strip_and_normalize_match_python_on_every_space(spark):
    samples = [f"{c}Ab{c}{c}cD{c}" for c in SPACES] + ["", " ", "x", "​x​", "a\n", "\n"]
    rows = spark.createDataFrame([(s,) for s in samples], "s string").select(
        "s", text.strip_u(F.col("s")).alias("t"), text.normalize(F.col("s")).alias("n")
    ).collect()
    assert len(SPACES) == 29
    for r in rows:
        assert r.t == r.s.strip()
        assert r.n == " ".join(r.s.strip().lower().split())


def test_fixed2_matches_python(spark):
    values = [2.675, 0.125, 1234567.125, -0.001, 0.0, 1e15, 99.995, 1.005, -2.5, 12.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", text.fixed2(F.col("v")).alias("t")
    ).collect()
    assert [r.t for r in rows] == [f"{r.v:.2f}" for r in rows]
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,)], "v double")
    assert [r[0] for r in odd.select(text.fixed2(F.col("v"))).collect()] == ["nan", "inf", "-inf"]


def test_fold_strips_and_lowers_any_text(spark):
    texts = ["", " ", "a", "A b", " A", "B ", "a\tb", "\ta", "É ", "　É", "x ", "a  B", "\x00a", "a\n", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.f for r in rows.select("i", text.fold(F.col("t")).alias("f")).collect()}
    assert got == {i: None if t is None else t.strip().lower() for i, t in enumerate(texts)}

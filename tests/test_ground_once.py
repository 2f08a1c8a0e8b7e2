"""Records are grounded in one pass, and what is written leaves no shuffle files beside it."""

import random

from pyspark.sql import functions as F

from ledgerproof.config import ALL_FIELDS
from ledgerproof.operators import ground
from ledgerproof.schemas import HINT, WORD
from ledgerproof.session import materialise


def _words(rng, odd):
    texts = ["acme", "corp", "INV-1", "10.00", "É", "x"] + (["a b", "", "Acme\tCo"] if odd else [])
    return [(rng.choice(texts), [float(rng.randint(0, 99)) for _ in range(4)] if rng.random() < 0.95 else None)
            for _ in range(rng.randint(0, 12))]


def _case(spark):
    """Hints in field order and not, fewer and more than fields; odd, empty, repeated and absent pages;
    records that share an id."""
    rng = random.Random(5)
    pages, rows = [], []
    for d in range(60):
        numbers = rng.choice([[1, 2], [1, 2], [1], [1, 1], [2, None], []])
        pages += [(f"d{d}", no, _words(rng, d % 3 == 0)) for no in numbers]
        for e in range(3):
            sources = ["acme corp", " ACME  corp", "inv-1", "10.00", "absent", "", None, "é x", "a b"]
            names = list(ALL_FIELDS)
            if rng.random() < 0.4:
                names = rng.sample(names, rng.randint(0, 8)) + ["other"] * rng.randint(0, 3)
            hints = [(f, rng.choice([1, 2, 3, None]), rng.choice(sources)) for f in names]
            rows.append((rng.choice([f"e{d}-{e}", f"e{d}-0", None]), f"d{d}", rng.choice([hints] * 9 + [None])))
    rows.append(("lost", None, [(f, 1, "acme") for f in ALL_FIELDS]))
    return (
        spark.createDataFrame(rows, f"extraction_id string, document_id string, hints array<{HINT}>"),
        spark.createDataFrame(pages, f"document_id string, page_no int, words array<{WORD}>"),
    )


def test_one_pass_finds_what_a_row_per_page_finds(spark):
    records, pages = _case(spark)

    def rows(df):
        return sorted(
            (str(r.extraction_id), str(r.document_id), sorted(map(str, r.matches or []))) for r in df.collect()
        )

    want = rows(ground.with_matches(records, ground.matches_of(records, pages)))
    got = ground.ground_records(records, pages)
    assert rows(got) == want and sum(len(m) for _, _, m in want) > 50
    kept = {(r.extraction_id, r.document_id): r.hints for r in records.where("size(hints) > 8").collect()}
    assert kept and all(
        any(r.hints == h for r in got.collect() if (r.extraction_id, r.document_id) == k) for k, h in kept.items()
    )
    bits = ground.with_found(records, pages).select("extraction_id", "document_id", "found").collect()
    names = {(str(e), str(d)): m for e, d, m in want}
    for r in bits:
        found = names[(str(r.extraction_id), str(r.document_id))]
        there = [i for i, f in enumerate(ALL_FIELDS) if any(f"field='{f}'" in m for m in found)]
        assert r.found == sum(1 << i for i in there)


def test_records_are_shuffled_once_to_be_grounded(spark):
    records, pages = _case(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ground.ground_records(records, pages)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = [x for x in plan.split("\n") if "Exchange" in x]
    assert len(exchanges) == 2 and all("document_id" in x for x in exchanges)


def test_what_is_written_leaves_no_shuffle_files(spark):
    def shuffled():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    before = shuffled()
    out = materialise(spark.range(1000).groupBy(F.col("id") % 7).count(), "sums")
    assert not shuffled() - before
    assert out.count() == 7

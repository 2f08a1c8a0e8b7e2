import random

from ledgerproof.operators.cross import duplicate_invoices
from ledgerproof.plans import dupstate


def changes_of(rng, n):
    """Changes of 14 documents: some of them new, some corrections of earlier values."""
    out = []
    for seq in range(n):
        out.append((
            f"d{rng.randrange(14):02d}", "t", rng.choice(["Acme", " ACME ", "Hot", "hot", None, ""]),
            rng.choice(["1", "1 ", "2", None]), seq,
        ))
    return out


def snapshot(spark, rows):
    """What the batch check says of the last values."""
    last = {}
    for r in sorted(rows, key=lambda r: r[4]):
        last[r[0]] = r
    df = spark.createDataFrame(list(last.values()), dupstate.VALUES).selectExpr(
        "document_id extraction_id", "document_id", "tenant_id", "supplier", "invoice_number")
    return {r.document_id: r.other_id for r in duplicate_invoices(df, df).collect()}


def test_any_order_of_batches_equals_the_snapshot(spark, tmp_path):
    rng = random.Random(21)
    rows = changes_of(rng, 40)
    batches = [rows[k:k + 10] for k in range(0, 40, 10)]
    expected = snapshot(spark, rows)
    assert expected
    for run, order in enumerate(([0, 1, 2, 3], [3, 1, 0, 2])):
        path, said = str(tmp_path / str(run)), {}
        for k in order:
            got = dupstate.apply_batch(spark.createDataFrame(batches[k], dupstate.VALUES), path, k)
            for r in got.collect():
                assert said.get(r.document_id) != r.other_id  # only what changed
                said[r.document_id] = r.other_id
        assert {d: o for d, o in said.items() if o is not None} == expected
        held = {r.document_id: r.other_id for r in dupstate.all_warnings(spark, path).collect()}
        assert held == expected


def test_a_correction_takes_warnings_back_and_a_replay_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "s")

    def apply(batch, *rows):
        df = spark.createDataFrame(list(rows), dupstate.VALUES)
        return {r.document_id: r.other_id for r in dupstate.apply_batch(df, path, batch).collect()}

    assert apply(0, ("a", "t", "Acme", "1", 1), ("b", "t", "acme ", "1", 2)) == {"a": "b", "b": "a"}
    assert apply(1, ("c", "t", "Acme", "1", 3), ("x", "u", "Acme", "1", 4)) == {"c": "a"}
    for _ in range(2):
        assert apply(2, ("a", "t", "Acme", "9", 5)) == {"a": None, "b": "c", "c": "b"}
    assert apply(3, ("c", "t", None, "1", 6)) == {"b": None, "c": None}
    assert apply(4, ("b", "t", "Acme", "9", 0)) == {}  # older than what is known
    assert dupstate.all_warnings(spark, path).count() == 0


def test_a_batch_reads_the_prefixes_of_its_keys_only(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [(f"d{k}", "t", f"S{k}", "1", k) for k in range(300)]
    dupstate.apply_batch(spark.createDataFrame(rows, dupstate.VALUES), path, 0)
    files = dupstate._read(spark, f"{path}/members", dupstate.MEMBERS, ["00", "a7"], None).inputFiles()
    assert 0 < len(files) <= 2 and all("prefix=00/" in f or "prefix=a7/" in f for f in files)

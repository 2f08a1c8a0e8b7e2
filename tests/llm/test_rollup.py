from ledgerproof.llm import rollup


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def counted(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n long, m long")


def test_signed_batches_and_replay(spark, tmp_path):
    path = str(tmp_path / "d")
    docs = counted(spark, [
        (1, "a", "en", 10, 12), (2, "a", "en", 5, 5), (3, None, None, 0, 4), (3, None, None, 0, 4),
    ])
    rollup.commit(rollup.inserts(docs, "n", "v1"), path, 1)
    cols = ("source", "lang", "version", "n_documents", "n_tokens")
    first = rows_of(rollup.totals(spark, path), *cols)
    assert first == sorted([("a", "en", "v1", 2, 15), (None, None, "v1", 2, 0)], key=repr)
    rollup.commit(rollup.inserts(docs, "n", "v1"), path, 1)
    assert rows_of(rollup.totals(spark, path), *cols) == first
    for _ in range(3):
        rollup.commit(rollup.revisions(docs, "n", "m", "v1"), path, 2)
    assert ("a", "en", "v1", 2, 17) in rows_of(rollup.totals(spark, path), *cols)
    for _ in range(2):
        rollup.commit(rollup.deletes(docs, "m", "v1"), path, 3)
        rollup.commit(rollup.deletes(docs.where("false"), "m", "v1"), path, 4)
    assert rows_of(rollup.totals(spark, path), *cols) == []


def test_copies_and_counts(spark, documents):
    docs = documents((1, "a b\na b"), (2, "a b\na b"), (3, None), (4, ""), (None, "a b\na b"), (5, "it's 12é"))
    found = rollup.counted_documents(docs)
    got = {r.doc_id: (r.words, r.line_words, r.pieces) for r in found.collect()}
    assert got[1] == (4, 2, 4) and got[3] == (0, 0, 0) and got[5] == (2, 2, 5)
    assert rows_of(rollup.copies(found), "doc_id") == [(2,), (4,)]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    rollup.commit(rollup.inserts(counted(spark, []), "n", "v"), path, 1)
    assert rollup.totals(spark, path).count() == 0


COLUMNS = ("source", "lang", "version", "n_documents", "n_tokens")


def test_a_replay_with_fewer_rows_replaces(spark, tmp_path):
    path = str(tmp_path / "d")
    docs = counted(spark, [(1, "a", "en", 10, 0), (2, "b", "en", 5, 0)])
    rollup.commit(rollup.inserts(docs, "n", "v"), path, 1)
    rollup.commit(rollup.inserts(docs.where("doc_id = 1"), "n", "v"), path, 1)
    assert rows_of(rollup.totals(spark, path), *COLUMNS) == [("a", "en", "v", 1, 10)]
    rollup.commit(rollup.inserts(docs.where("false"), "n", "v"), path, 1)
    assert rollup.totals(spark, path).count() == 0


def test_compaction_keeps_totals_and_knows_its_batches(spark, tmp_path):
    path, into = str(tmp_path / "d"), str(tmp_path / "e")
    docs = counted(spark, [(k, "ab"[k % 2], None, k, 0) for k in range(20)])
    for batch in range(4):
        rollup.commit(rollup.inserts(docs.where(f"doc_id % 4 = {batch}"), "n", "v"), path, batch)
    before = rows_of(rollup.totals(spark, path), *COLUMNS)
    for _ in range(2):
        rollup.compact(spark, path, into, 2)
    assert rows_of(rollup.totals(spark, into), *COLUMNS) == before
    rollup.commit(rollup.inserts(docs, "n", "v"), into, 1)  # taken in already
    assert rows_of(rollup.totals(spark, into), *COLUMNS) == before
    rollup.commit(rollup.inserts(docs.where("false"), "n", "v"), into, 3)
    rollup.commit(rollup.inserts(docs.where("doc_id % 4 = 3"), "n", "v"), into, 4)
    assert rows_of(rollup.totals(spark, into), *COLUMNS) == before


def test_clashing_columns_and_long_texts(spark, documents):
    from pyspark.sql import functions as F

    docs = documents((1, "word " * 300_000)).withColumns({c: F.lit("x") for c in ("words", "digest", "t")})
    assert rollup.counted_documents(docs).first().words == 300_000

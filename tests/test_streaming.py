import os

from pyspark.sql import functions as F

from ledgerproof.plans.intake import intake
from ledgerproof.schemas import DOCUMENTS
from ledgerproof.sources import files
from ledgerproof.streaming import flows


def put(folder, tenant, name, content):
    target = folder / f"tenant_id={tenant}"
    target.mkdir(parents=True, exist_ok=True)
    (target / name).write_bytes(content)


def test_ingest_stream_equals_batch_and_never_repeats(spark, tmp_path):
    uploads = tmp_path / "uploads"
    put(uploads, "a", "one.pdf", b"%PDF-1.4 one")
    put(uploads, "a", "copy.pdf", b"%PDF-1.4 one")
    put(uploads, "b", "one.pdf", b"%PDF-1.4 one")
    put(uploads, "a", "evil.pdf", b"%PDF-1.4 /JavaScript")
    put(uploads, "a", "x.exe", b"MZ\x00")
    paths = [str(tmp_path / p) for p in ("documents", "refused", "checkpoint")]

    def run():
        stream = files.stream_uploads(spark, str(uploads))
        flows.ingest_stream(stream, *paths).awaitTermination()
        return spark.read.parquet(paths[0])

    first = run()
    assert first.count() == 2
    put(uploads, "a", "again.pdf", b"%PDF-1.4 one")
    put(uploads, "a", "new.pdf", b"%PDF-1.4 two")
    both = run()
    assert both.groupBy("tenant_id", "file_hash").count().where("count > 1").count() == 0
    batch, refused = intake(
        files.read_uploads(spark, str(uploads)), spark.createDataFrame([], DOCUMENTS)
    )
    keys = ["tenant_id", "file_hash", "mime_type", "status"]
    assert sorted(map(tuple, both.select(*keys).collect())) == sorted(
        map(tuple, batch.select(*keys).collect()))
    reasons = {r.upload_id: r.reasons for r in refused.collect()}
    assert sorted(r[0] for r in reasons.values()) == [
        "PDF contains disallowed object '/JavaScript'",
        "file content type 'unknown' is not allowed",
    ]
    assert spark.read.parquet(paths[1]).count() == 2


def test_new_checkpoint_and_rerun_lose_nothing(spark, tmp_path):
    uploads = tmp_path / "uploads"
    documents, refused = str(tmp_path / "documents"), str(tmp_path / "refused")

    def run(checkpoint):
        flows.ingest_stream(
            files.stream_uploads(spark, str(uploads)), documents, refused, str(tmp_path / checkpoint)
        ).awaitTermination()
        rows = spark.read.parquet(documents).collect()
        assert len({(r.tenant_id, r.file_hash) for r in rows}) == len(rows)
        return sorted(r.filename for r in rows)

    put(uploads, "a", "one.pdf", b"%PDF-1.4 one")
    assert run("first") == ["one.pdf"]
    put(uploads, "a", "again.pdf", b"%PDF-1.4 one")
    put(uploads, "a", "two.pdf", b"%PDF-1.4 two")
    assert run("second") == ["one.pdf", "two.pdf"]
    assert run("first") == ["one.pdf", "two.pdf"]
    # A batch whose commit was lost runs again and leaves the same rows.
    for commit in (tmp_path / "first" / "commits").glob("*1*"):
        commit.rename(tmp_path / f"lost-{commit.name}")
    assert run("first") == ["one.pdf", "two.pdf"]


def test_page_facts_and_stage_stream(spark, tmp_path):
    uploads = tmp_path / "uploads"
    put(uploads, "a", "long.pdf", b"%PDF-1.4 long")
    put(uploads, "a", "short.pdf", b"%PDF-1.4 short")

    def facts(batch):
        return batch.withColumn(
            "page_count", F.when(F.col("filename") == "long.pdf", 30).otherwise(2).cast("int"))

    paths = [str(tmp_path / p) for p in ("documents", "refused", "cp")]
    flows.ingest_stream(
        files.stream_uploads(spark, str(uploads)), *paths, page_facts=facts).awaitTermination()
    assert [r.filename for r in spark.read.parquet(paths[0]).collect()] == ["short.pdf"]
    (refused,) = spark.read.parquet(paths[1]).collect()
    assert "30 pages" in refused.reasons[0]
    out = str(tmp_path / "names")
    for checkpoint in ("cp1", "cp2"):
        stream = files.stream_uploads(spark, str(uploads))
        flows.stage_stream(
            stream, lambda rows: rows.select("filename"), out, str(tmp_path / checkpoint)
        ).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_malformed_label_is_an_error(spark, tmp_path):
    import pytest

    (tmp_path / "bad.json").write_text('{"supplier": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_labels(spark, str(tmp_path)).collect()


def test_outbox_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(
        [("d1", "t", "invoice", "approved", 1.0), ("d2", "t", "invoice", "needs_review", 0.5)],
        "id string, tenant_id string, doc_type string, status string, confidence double",
    ).write.parquet(source)
    documents = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    data = spark.createDataFrame([("d1", 7.0)], "document_id string, total double").select(
        "document_id", F.struct("total").alias("data"))
    out = os.path.join(tmp_path, "out")
    flows.outbox_stream(documents, data, out, str(tmp_path / "cp")).awaitTermination()
    (row,) = spark.read.parquet(out).collect()
    assert '"event":"document.approved"' in row.payload and '"total":7.0' in row.payload


def test_labels_and_samples(spark, tmp_path):
    from ledgerproof.operators.evaluate import eval_samples, orphan_labels

    (tmp_path / "real.json").write_text('{\n"supplier": "Acme"}')
    (tmp_path / "real.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "letter.json").write_text('{"doc_type": "non_invoice"}')
    (tmp_path / "letter.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "orphan.json").write_text('{"supplier": "B"}')
    labels = files.read_labels(spark, str(tmp_path))
    pdfs = files.read_sample_files(spark, str(tmp_path))
    assert [r.sample for r in eval_samples(labels, pdfs).collect()] == ["real"]
    assert [r.sample for r in orphan_labels(labels, pdfs).collect()] == ["orphan"]

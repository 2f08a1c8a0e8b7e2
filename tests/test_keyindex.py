import hashlib
import re

from pyspark.sql import functions as F

from ledgerproof.sources import files, keyindex
from ledgerproof.streaming import flows


def keys(spark, numbers, tenant="t"):
    rows = [(tenant, hashlib.sha256(b"%d" % n).hexdigest(), f"{tenant}{n}") for n in numbers]
    return spark.createDataFrame(rows, "tenant_id string, file_hash string, id string")


def add(spark, path, numbers, batch, digits=2):
    rows = keys(spark, numbers)
    keyindex.add_keys(rows, rows, path, "s", batch, digits)


def scan_of(df):
    """How many files the plan reads, and its partition filters."""
    plan = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return len(df.inputFiles()), re.findall(r"Location: .*", plan)


def test_a_batch_reads_its_own_prefixes_only(spark, tmp_path):
    path = str(tmp_path / "keys")
    asked = keys(spark, [3, 77, 5000])
    prefixes = keyindex.prefixes_of(asked, 2)
    read = []
    for batch in range(3):  # the table grows threefold
        add(spark, path, range(batch * 400, batch * 400 + 400), batch)
        keyindex.compact(spark, path, f"{path}-{batch}")
        found = keyindex.known_keys(spark, f"{path}-{batch}", prefixes)
        read.append(len(found.inputFiles()))
        assert all(re.search(f"prefix=({'|'.join(prefixes)})/", f) for f in found.inputFiles())
    assert read == [len(prefixes)] * 3 and len(prefixes) == 3
    hits = found.join(asked.drop("id"), ["tenant_id", "file_hash"])
    assert sorted(r.document_id for r in hits.collect()) == ["t3", "t77"]
    assert keyindex.known_keys(spark, str(tmp_path / "none"), prefixes).count() == 0
    assert keyindex.known_keys(spark, path, []).count() == 0


def test_a_batch_does_not_see_itself_and_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "keys")
    add(spark, path, [1, 2], 0)
    add(spark, path, [3], 1)
    everything = [format(k, "02x") for k in range(256)]

    def seen(own=None):
        return sorted(r.document_id for r in keyindex.known_keys(spark, path, everything, own).collect())

    assert seen() == ["t1", "t2", "t3"] and seen(("s", 0)) == ["t3"]
    asked = keys(spark, [1, 2])
    keyindex.add_keys(asked, asked.where("id = 't2'"), path, "s", 0, 2)  # 1 is refused this time
    assert seen() == ["t2", "t3"]


def put(folder, name, content):
    target = folder / "tenant_id=a"
    target.mkdir(parents=True, exist_ok=True)
    (target / name).write_bytes(content)


def test_stream_finds_copies_of_earlier_batches_by_the_index(spark, tmp_path):
    uploads = tmp_path / "up"
    paths = [str(tmp_path / p) for p in ("documents", "refused", "cp")]
    allowed = {"yes": True}

    def facts(batch):
        return batch.withColumn("page_count", F.lit(1 if allowed["yes"] else 99).cast("int"))

    def run():
        flows.ingest_stream(
            files.stream_uploads(spark, str(uploads)), *paths, page_facts=facts).awaitTermination()
        return sorted(r.filename for r in spark.read.parquet(paths[0]).collect())

    for k in range(5):
        put(uploads, f"{k}.pdf", b"%%PDF-1.4 %d" % k)
        put(uploads, f"copy{k}.pdf", b"%%PDF-1.4 %d" % (k // 2))
        assert len(run()) == k + 1
    # The last batch runs again, and now its upload is refused: its document goes.
    allowed["yes"] = False
    for kind in ("commits",):
        last = max((tmp_path / "cp" / kind).glob("[0-9]*"), key=lambda p: int(p.name))
        last.rename(tmp_path / f"lost-{last.name}")
        crc = last.parent / f".{last.name}.crc"
        if crc.exists():
            crc.rename(tmp_path / f"lost-{crc.name}")
    assert len(run()) == 4
    allowed["yes"] = True
    put(uploads, "late.pdf", b"%PDF-1.4 4")  # accepted now, since nothing stayed of the refused one
    assert len(run()) == 5

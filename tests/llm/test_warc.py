import hashlib

from ledgerproof.llm import warc


def pages(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
        "digest", F.lit("mine")
    ).withColumn("id", F.lit(3))


def test_round_trip_and_revisits(spark, tmp_path):
    long = "<p>é " + "x" * 200
    tricky = [
        "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb", "WARC/1.1", "\r\nWARC/1.1\r\n", "WARC/1.1\r\n" * 3,
        "ends WARC/1.1", "\r\n\r\n", "WARC", "/1.1\r\n", "", None, "é𝔸", "y" * 3_000_000,
    ]
    rows = [(k, f"http://h/{k}", t) for k, t in enumerate(tricky)]
    rows += [(50, None, long), (40, "http://a/\r\nWARC/1.1 b", long), (60, "u", long), (None, "n", long)]
    rows += [(70, "u", "short"), (71, "u", "short"), (80, "r", "z" * 100), (80, "r", "z" * 100)]
    path = str(tmp_path / "a")
    warc.write_archives(pages(spark, rows), path)
    records = warc.read_archives(spark, path)
    kept = [r.payload for r in records.where("warc_type = 'response'").collect()]
    assert sorted(kept) == sorted(
        [t or "" for t in tricky] + [long, long, "short", "short", "z" * 100, "z" * 100]
    )
    got = {}
    for r in warc.resolved_records(records).collect():
        got.setdefault(r.source_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for number, _, text in rows:
        data = (text or "").encode()
        for r in got[number]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert (got[40][0].warc_type, got[40][0].refers_to) == ("response", None)
    assert (got[50][0].warc_type, got[50][0].refers_to) == ("revisit", 40)
    assert (got[60][0].warc_type, got[60][0].refers_to) == ("revisit", 40)
    assert got[None][0].warc_type == "response"
    assert {r.warc_type for k in (70, 71, 80) for r in got[k]} == {"response"}
    # Rewriting the archive gives its revisits their payloads back first.
    again = str(tmp_path / "b")
    warc.deduplicated(records, again)
    after = warc.resolved_records(warc.read_archives(spark, again))
    want = sorted((r.source_id or -1, r.payload_digest, r.warc_type) for x in got.values() for r in x)
    assert sorted((r.source_id or -1, r.payload_digest, r.warc_type) for r in after.collect()) == want


def test_segments_never_hold_a_version_line(spark):
    for text in ("WARC/1.1\r\n", "xWARC/1.1\r\nWARC/1.1\r\ny", "WARC/1.1", "a", ""):
        df = spark.createDataFrame([(text,)], "t string")
        pieces = df.select(warc.segments(df.t)).first()[0]
        assert "".join(pieces) == text
        assert not any("WARC/1.1\r\n" in p + "\r\n" for p in pieces)


def test_many_revisits_are_joined_by_id(spark, tmp_path):
    rows = [(k, f"http://h/{k % 7}", f"{k % 5} " * 99) for k in range(60)]
    found = {}
    for bound in (0, 1000):
        path = str(tmp_path / f"bound{bound}")
        warc.write_archives(pages(spark, rows), path, options=warc.Options(broadcast=bound))
        text = "".join(r.value for r in spark.read.option("lineSep", warc.VERSION).text(path).collect())
        assert text.count("WARC-Refers-To-Target-URI: http://h/") == 55
        assert text.count("WARC-Refers-To-Date: ") == 55
        got = warc.resolved_records(warc.read_archives(spark, path)).collect()
        found[bound] = sorted((r.source_id, r.warc_type, r.refers_to, r.payload_digest) for r in got)
    assert found[0] == found[1000]
    assert [r[2] for r in found[0]] == [None if k < 5 else k % 5 for k in range(60)]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(pages(spark, []), path)
    assert warc.resolved_records(warc.read_archives(spark, path)).count() == 0

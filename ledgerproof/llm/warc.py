"""WARC archives with revisit resolution.

Headers (id, URL, size, digest) are written once and shuffled by payload digest to find the original
of each group of equal payloads. The ids of the revisits go to all tasks if there are at most
`broadcast` of them; then payloads stay with their rows until the archive is written. Beyond that
number the rows are joined by id and digest, which shuffles the payloads once. A revisit record holds
no payload but names the record it repeats; on reading, revisits are joined to the originals.

Files are written and read by Spark's text source, which names them `.txt.gz`: a record starts with
`WARC/1.1` and ends with two line breaks, and the reader splits at the version line. A block that
contains a version line itself is written as a WARC segmented record, cut inside that line, so that
the split is always exact. `Content-Length` is checked on reading. Each file is one gzip stream of
many records.

Defined cases: a null payload is an empty one; a null id is always a response and never an original
that others refer to; rows that share id and payload are all the same original; a null URL has no
`WARC-Target-URI`; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerproof.llm.common import fresh_folder, staged, table

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Options:
    """`smallest`: payloads with fewer bytes are always responses. `date` stamps the records.
    `broadcast`: so many revisits, of some 200 bytes each, may go to all tasks."""

    smallest: int = 100
    date: str = "2024-01-01T00:00:00Z"
    compression: str = "gzip"
    broadcast: int = 200_000


DEFAULT = Options()


def captures(pages: DataFrame, record_id: str, url: str, payload: str) -> DataFrame:
    """`id, url, payload, n_bytes, digest` of each page."""
    return pages.select(
        F.col(record_id).alias("id"), F.col(url).alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"),
    ).withColumns({
        "n_bytes": F.octet_length("payload").cast("long"),
        "digest": F.sha2(F.col("payload").cast("binary"), 256),
    })


def originals(headers: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """`digest, original, original_url` of every payload that more than one record holds."""
    return headers.where(F.col("n_bytes") >= options.smallest).groupBy("digest").agg(
        F.min("id").alias("original"), F.min_by("url", "id").alias("original_url"),
        F.count("*").alias("n"),
    ).where((F.col("n") > 1) & F.col("original").isNotNull()).drop("n")


def revisits(headers: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """`id, digest, refers_to, refers_url` of the records that repeat an earlier payload."""
    return headers.join(originals(headers, options), "digest").where(
        (F.col("n_bytes") >= options.smallest) & (F.col("id") != F.col("original"))
    ).groupBy("id", "digest").agg(
        F.min("original").alias("refers_to"), F.min("original_url").alias("refers_url")
    )


def urn(record: Column) -> Column:
    """A record id made from the id, the same in every run."""
    h = F.md5(F.concat(F.lit("record:"), record.cast("string")))
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
        F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"),
        F.substring(h, 21, 12), F.lit(">"),
    )


def header_line(name: str, value: Column) -> Column:
    """`name: value`, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def safe_url(url: Column) -> Column:
    """A URL that fits on a header line and holds no version line."""
    return F.replace(
        F.regexp_replace(url, "[\\x00-\\x20]", "%20"), F.lit("WARC/1.1"), F.lit("WARC%2F1.1")
    )


def segments(block: Column) -> Column:
    """The block cut inside every version line it contains; one piece for nearly all blocks."""
    # With the line break that follows the block, its end is looked at as well.
    ended = F.concat(block, F.lit("\r\n"))
    parts = F.split(ended, "WARC/1\\.1\r\n")
    last = F.size(parts) - 1
    pieces = F.transform(parts, lambda part, k: F.concat(
        F.when(k > 0, "/1.1\r\n").otherwise(""), part, F.when(k < last, "WARC").otherwise("")
    ))
    cut = F.transform(pieces, lambda piece, k: F.when(
        k == last, F.substring(piece, F.lit(1), F.length(piece) - 2)
    ).otherwise(piece))
    return F.when(F.contains(ended, F.lit(VERSION)), cut).otherwise(F.array(block))


def record_texts(resolved: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """The text of each record, without the two line breaks at its end."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n_bytes").cast("string"), F.lit(END),
    )
    cut = resolved.select(
        "id", "url", "digest", "refers_to", "refers_url",
        F.coalesce(urn(F.col("id")), F.lit("<urn:uuid:none>")).alias("urn"),
        F.concat(http, F.when(revisit, "").otherwise(F.col("payload"))).alias("block"),
    ).select(
        "id", "url", "digest", "refers_to", "refers_url", "urn",
        F.octet_length("block").alias("total"),
        F.posexplode(segments(F.col("block"))).alias("k", "piece"),
    ).withColumn("size", F.octet_length("piece"))
    first = F.col("k") == 0
    whole = first & (F.col("size") == F.col("total"))
    kind = F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")
    return cut.select(F.concat(
        F.lit(VERSION),
        header_line("WARC-Type", kind),
        header_line("WARC-Record-ID", F.when(first, F.col("urn")).otherwise(
            urn(F.concat_ws(":", F.col("urn"), F.col("digest"), F.col("k"))))),
        header_line("WARC-Date", F.lit(options.date)),
        header_line("WARC-Target-URI", safe_url(F.col("url"))),
        header_line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        header_line("WARC-Profile", F.when(first & revisit, F.lit(PROFILE))),
        header_line("WARC-Refers-To", F.when(first & revisit, urn(F.col("refers_to")))),
        header_line(
            "WARC-Refers-To-Target-URI", F.when(first & revisit, safe_url(F.col("refers_url")))
        ),
        header_line("WARC-Refers-To-Date", F.when(first & revisit, F.lit(options.date))),
        header_line("WARC-Segment-Number", F.when(~whole, F.col("k") + 1)),
        header_line("WARC-Segment-Origin-ID", F.when(~first, F.col("urn"))),
        header_line("WARC-Segment-Total-Length", F.when(~whole, F.col("total"))),
        header_line("X-Source-ID", F.col("id")),
        header_line("X-Refers-To-Source-ID", F.when(first, F.col("refers_to"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        header_line("Content-Length", F.col("size")),
        F.lit("\r\n"), F.col("piece"),
    ).alias("value"))


def write_archives(
    pages: DataFrame, path: str, record_id: str = "page_id", url: str = "url",
    payload: str = "html", options: Options = DEFAULT,
) -> None:
    """Write one record per page: the first of each group of equal payloads in full, the rest as
    revisits of it."""
    found = captures(pages, record_id, url, payload)
    headers = staged(found.drop("payload"))
    repeats = staged(revisits(headers, options))
    if repeats.limit(options.broadcast + 1).count() <= options.broadcast:
        repeats = F.broadcast(repeats)
    resolved = found.join(repeats, ["id", "digest"], "left")
    record_texts(resolved, options).write.option("lineSep", END).option(
        "compression", options.compression
    ).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives: `warc_type, record_id, url, date, digest, refers_to_urn,
    source_id, refers_to, payload`, segments joined. `digest` is what the header states. A record
    whose block is not as long as stated is an error."""
    # Sizes are bytes; the blank line is looked for once per record, and nothing is cut twice.
    rows = spark.read.option("lineSep", VERSION).text(path).where(F.col("value") != "").select(
        F.substring_index("value", END, 1).alias("head"), F.col("value").cast("binary").alias("bytes"),
    ).select(
        "head", F.split("head", "\r\n").alias("fields"),
        F.expr("substring(bytes, octet_length(head) + 5, octet_length(bytes) - octet_length(head) - 8)")
        .alias("block"),
    )

    def field(name: str) -> Column:
        line = F.get(F.filter("fields", lambda x: F.startswith(x, F.lit(f"{name}: "))), F.lit(0))
        value = F.substring(line, len(name) + 3, 1 << 30)
        return F.when(value != "", value)

    records = rows.select(
        field("WARC-Type").alias("warc_type"), field("WARC-Record-ID").alias("record_id"),
        field("WARC-Target-URI").alias("url"), field("WARC-Date").alias("date"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("digest"),
        field("WARC-Refers-To").alias("refers_to_urn"),
        field("X-Source-ID").cast("long").alias("source_id"),
        field("X-Refers-To-Source-ID").cast("long").alias("refers_to"),
        field("WARC-Segment-Number").cast("int").alias("segment"),
        field("WARC-Segment-Origin-ID").alias("origin"),
        F.when(
            F.octet_length("block") == field("Content-Length").cast("long"),
            F.col("block").cast("string"),
        ).otherwise(
            F.raise_error(F.concat(F.lit("damaged WARC record: "), F.col("head")))
        ).alias("block"),
    )
    plain = ("warc_type", "record_id", "url", "date", "digest", "refers_to_urn", "source_id",
             "refers_to")
    single = records.where(F.col("segment").isNull()).select(*plain, "block")
    # Pieces of one record meet again; there are as many as its block has version lines.
    joined = records.where(F.col("segment").isNotNull()).groupBy(
        F.coalesce("origin", "record_id").alias("whole"), "digest"
    ).agg(
        *[F.max_by(c, -F.col("segment")).alias(c) for c in plain if c != "digest"],
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("pieces"),
    ).withColumn(
        "block", F.array_join(F.transform("pieces", lambda p: p["block"]), "")
    ).select(*plain, "block")
    # The HTTP head is cut off by bytes.
    http = F.octet_length(F.substring_index("block", END, 1))
    return single.unionByName(joined).withColumn("payload", F.substring(
        F.col("block").cast("binary"), http + 5, F.octet_length("block")
    ).cast("string")).drop("block")


def resolved_records(records: DataFrame) -> DataFrame:
    """Every record with the size and digest of its full payload. Responses are measured; revisits
    are joined to the response they refer to, by record id, and take its measures. The archives are
    parsed once; what is measured is written."""
    measured = staged(records.withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"),
        "payload_digest": F.sha2(F.col("payload").cast("binary"), 256),
    }).drop("payload"))
    found = measured.where(F.col("warc_type") == "response").groupBy(
        F.col("record_id").alias("refers_to_urn"), F.col("payload_digest").alias("digest")
    ).agg(F.max("payload_bytes").alias("found_bytes"))
    lookup = measured.where(F.col("warc_type") == "revisit").join(
        found, ["refers_to_urn", "digest"], "left"
    )
    missing = F.raise_error(F.concat(F.lit("no response for revisit "), F.col("record_id")))
    columns = ["source_id", "warc_type", "record_id", "url", "digest", "refers_to"]
    return measured.where(F.col("warc_type") == "response").select(
        *columns, "payload_bytes", "payload_digest"
    ).unionByName(lookup.select(
        *columns,
        F.when(F.col("found_bytes").isNull(), missing.cast("long"))
        .otherwise(F.col("found_bytes")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
    ))


def deduplicated(records: DataFrame, path: str, options: Options = DEFAULT) -> None:
    """Rewrite the records of other archives: revisits get their originals' payloads back, equal
    payloads are found anew, and the result is written with fresh headers."""
    responses = records.where(F.col("warc_type") == "response")
    payloads = responses.groupBy(
        F.col("record_id").alias("refers_to_urn"), "digest"
    ).agg(F.max("payload").alias("full"))
    full = records.where(F.col("warc_type") == "revisit").join(
        payloads, ["refers_to_urn", "digest"]
    ).select("source_id", "url", F.col("full").alias("payload")).unionByName(
        responses.select("source_id", "url", "payload")
    )
    write_archives(full, path, "source_id", "url", "payload", options)


def op1_revisit_resolution(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark, "warc")
    write_archives(table(spark, folder, "pages"), path)
    return resolved_records(read_archives(spark, path)).select(
        F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("warc_type").alias("record_type"), "refers_to",
    )


SQL = {"op1_revisit_resolution": r"""
WITH h AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM h
), o AS (
  SELECT digest, min(page_id) AS original FROM d WHERE n >= 100 GROUP BY digest
)
SELECT page_id, n::BIGINT AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM d LEFT JOIN o ON d.digest = o.digest AND d.n >= 100
"""}

QUERIES = {"op1_revisit_resolution": op1_revisit_resolution}

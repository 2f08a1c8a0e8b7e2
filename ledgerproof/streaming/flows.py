"""The batch operators run per micro-batch over tables in a shared folder.

Each sink writes the folder of its own stream and batch (`stream_id, batch_id`) and replaces it as a
whole, so a batch that is run again after a failure leaves the same rows as one run, also if there are
none now, and a second stream over the same table, or one with a new checkpoint, never touches what is
there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ledgerproof.config import DEFAULTS, Settings
from ledgerproof.operators.ingest import approved_outbox
from ledgerproof.plans.intake import admit, gate
from ledgerproof.session import materialise
from ledgerproof.sources import keyindex
from ledgerproof.sources.files import write_stage


def _stream_id(spark: SparkSession) -> str:
    """The id that the running query keeps in its checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    write_stage(df, f"{path}/stream_id={_stream_id(df.sparkSession)}/batch_id={batch_id}")


def ingest_stream(
    uploads: DataFrame, documents_path: str, refused_path: str, checkpoint: str,
    settings: Settings = DEFAULTS, available_now: bool = True,
    page_facts: Callable[[DataFrame], DataFrame] | None = None, keys_path: str | None = None,
    digits: int = keyindex.DIGITS,
) -> StreamingQuery:
    """Gate and deduplicate a stream of uploads into the documents table.

    Whether content was seen before is asked of an index by hash prefix (`keys_path`, by default
    beside the documents), so the answer holds forever without streaming state, and a batch reads the
    prefixes of its own uploads and nothing of the documents table. `page_facts` fills in `open_error, is_encrypted,
    page_count` of a batch, which the bytes alone do not tell. The bytes are read once per batch:
    what the gate finds is narrow, and is written before it is used twice.
    """

    keys = keys_path or f"{documents_path.rstrip('/')}-keys"

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        facts = batch if page_facts is None else page_facts(batch)
        gated = materialise(gate(facts, settings, "content_hash"), "gated")
        asked = gated.select("tenant_id", F.col("content_hash").alias("file_hash"))
        own = (_stream_id(spark), batch_id)
        known = keyindex.known_keys(spark, keys, keyindex.prefixes_of(asked, digits), own)
        fresh, refused = admit(gated.drop("content_hash"), known)
        fresh = materialise(fresh, "fresh")
        # Keys first: a batch that dies in between leaves keys of its own, which it does not see.
        keyindex.add_keys(asked, fresh, keys, *own, digits)
        _write(fresh, documents_path, batch_id)
        _write(refused, refused_path, batch_id)

    return _start(uploads, each, checkpoint, available_now)


def outbox_stream(
    documents: DataFrame, data: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Write one JSON event per approved document of a documents stream."""

    def each(batch: DataFrame, batch_id: int) -> None:
        _write(approved_outbox(batch, data), path, batch_id)

    return _start(documents, each, checkpoint, available_now)


def stage_stream(
    rows: DataFrame, stage, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Run a batch function `stage(rows) -> rows` on each micro-batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        _write(stage(batch), path, batch_id)

    return _start(rows, each, checkpoint, available_now)


def _start(rows: DataFrame, each, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

"""An index of the contents that a tenant has uploaded, read by hash prefix.

The table holds `tenant_id, file_hash, document_id` and is partitioned by the first digits of the
hash, with Parquet's Bloom filters on the hash. A batch of uploads reads the prefixes of its own
hashes only, by their folders, so nothing else is even listed. Hashes spread evenly: with `digits`
chosen by the size of the table (16^digits partitions), what a batch reads does not grow with it.

A batch adds one row per content it was asked about, also for what the gate refused (`document_id`
is null then). So which partitions a batch writes depends on the bytes of its uploads alone, and a
batch that runs again replaces all of its earlier rows. `compact` brings the files of many batches
together.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = "tenant_id string, file_hash string, document_id string"
DIGITS = 3
COMPACTED = "compacted"


def prefix(file_hash: Column, digits: int = DIGITS) -> Column:
    return F.substring(file_hash, 1, digits)


def known_keys(
    spark: SparkSession, path: str, prefixes: list[str], own: tuple[str, int] | None = None
) -> DataFrame:
    """`tenant_id, file_hash, document_id` of the accepted contents with these prefixes, without the
    rows of the stream and batch `own`."""
    schema = f"{KEYS}, stream_id string, batch_id bigint, prefix string"
    found = spark.createDataFrame([], schema)
    if prefixes:
        reader = spark.read.schema(schema).option("basePath", path)
        try:
            # A glob of the wanted folders: others are not listed, missing ones are no error.
            found = reader.parquet(f"{path}/prefix={{{','.join(sorted(prefixes))}}}")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
    if own is not None:
        found = found.where(~((F.col("stream_id") == own[0]) & (F.col("batch_id") == own[1])))
    return found.where(F.col("document_id").isNotNull()).select("tenant_id", "file_hash", "document_id")


def prefixes_of(uploads: DataFrame, digits: int = DIGITS) -> list[str]:
    """The prefixes of a batch, at most 16^digits short texts."""
    rows = uploads.select(prefix(F.col("file_hash"), digits).alias("p")).where("p is not null")
    return [r["p"] for r in rows.distinct().collect()]


def add_keys(
    uploads: DataFrame, documents: DataFrame, path: str, stream_id: str, batch_id: int,
    digits: int = DIGITS,
) -> None:
    """Write a batch's keys: `uploads` has `tenant_id, file_hash` of all contents it was asked about,
    `documents` `id, tenant_id, file_hash` of the new ones."""
    rows = uploads.select("tenant_id", "file_hash").where("file_hash is not null").distinct().join(
        documents.select("tenant_id", "file_hash", F.col("id").alias("document_id")),
        ["tenant_id", "file_hash"], "left",
    ).select(
        "tenant_id", "file_hash", "document_id", prefix(F.col("file_hash"), digits).alias("prefix"),
        F.lit(stream_id).alias("stream_id"), F.lit(batch_id).cast("bigint").alias("batch_id"),
    )
    _written(rows, path)


def _written(rows: DataFrame, path: str) -> None:
    # One file per partition, in the order of the hash, so that readers skip by its range as well.
    rows.repartition("prefix").sortWithinPartitions("prefix", "file_hash").write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").option(
        "parquet.bloom.filter.enabled#file_hash", "true"
    ).partitionBy("prefix", "stream_id", "batch_id").parquet(path)


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Write the index anew to the folder `into`, one file per prefix. Writers change to it when it
    is done; a batch that ran before does not run again on it."""
    rows = spark.read.schema(f"{KEYS}, prefix string").parquet(path).where("document_id is not null")
    _written(
        rows.groupBy("prefix", "tenant_id", "file_hash").agg(F.min("document_id").alias("document_id"))
        .select(
            "tenant_id", "file_hash", "document_id", "prefix", F.lit(COMPACTED).alias("stream_id"),
            F.lit(-1).cast("bigint").alias("batch_id"),
        ), into,
    )

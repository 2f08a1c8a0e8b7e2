"""Reading uploads and label files, writing stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL_SCHEMA = (
    "supplier string, invoice_number string, invoice_date string, due_date string, "
    "currency string, subtotal double, tax double, total double, doc_type string"
)


def _upload_columns(files: DataFrame) -> DataFrame:
    """Binary files under `tenant_id=<name>/` folders as upload rows.

    Page facts are not known from the bytes alone; a reader that knows them
    fills the three columns in.
    """
    return files.select(
        F.sha2(F.concat_ws("|", "path", F.col("modificationTime").cast("string")), 256)
        .alias("upload_id"),
        F.regexp_extract("path", r"tenant_id=([^/]+)/", 1).alias("tenant_id"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        "content",
        F.col("modificationTime").alias("created_at"),
        F.lit(None).cast("string").alias("open_error"),
        F.lit(False).alias("is_encrypted"),
        F.lit(None).cast("int").alias("page_count"),
    )


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return _upload_columns(files)


def stream_uploads(spark: SparkSession, path: str) -> DataFrame:
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return _upload_columns(files)


def _stem(path):
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files (one JSON object each), with `sample`, the file's stem. A malformed file is an
    error, not a row of nulls."""
    files = spark.read.schema(LABEL_SCHEMA).option("multiLine", "true").option(
        "mode", "FAILFAST"
    ).json(f"{path}/*.json")
    return files.withColumn("sample", _stem(F.col("_metadata.file_path")))


def read_sample_files(spark: SparkSession, path: str) -> DataFrame:
    """The stems of the PDF files; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select(_stem(F.col("path")).alias("sample"), "path")


def write_stage(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write a stage's rows, replacing only the partitions they belong to.

    Running a stage again for the same batch replaces its earlier output.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)

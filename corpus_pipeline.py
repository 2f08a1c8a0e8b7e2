"""A training corpus from raw documents, in five stages.

Each stage reads what its predecessor wrote and returns the columns of documents; the last returns
the bins. Texts change where a stage's decision asks for it: boilerplate lines are taken out and
personal data is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerproof.llm.common import fresh_folder, table
from ledgerproof.llm.language import language_id
from ledgerproof.llm.packing import packed
from ledgerproof.llm.pii import redacted, train, with_spans
from ledgerproof.llm.quality import cleaned
from ledgerproof.llm.setsketch import near_duplicates


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name in docs.columns:
        name += "_"
    return name


def retexted(docs: DataFrame, columns: list[str], text) -> DataFrame:
    """The columns of documents with a new text, and its length where they have one."""
    new = docs.withColumn("text", text)
    if "n_chars" in columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the dictionaries are learned from the labelled ones."""
    into = unused(docs, "language")
    return language_id(docs, into=into).where(~F.col(f"{into}.rejected")).select(*docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep enough, without the lines that many documents of their source share."""
    return cleaned(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest id, null last. Rows are told apart by a
    key of their own, since ids may be null or repeated; it is written, so that it stays the same."""
    key = unused(docs, "row_key")
    path = fresh_folder(spark, "corpus-keyed")
    docs.withColumn(key, F.monotonically_increasing_id()).write.option(
        "compression", "zstd"
    ).parquet(path)
    keyed = spark.read.parquet(path)
    gone = near_duplicates(keyed, row=key).where(~F.col("kept")).select(F.col("row").alias(key))
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of each span of personal data in its place."""
    into = unused(docs, "pii")
    found = with_spans(docs, train(docs.select("doc_id", "text")), into=into)
    return retexted(found, docs.columns, redacted(found, F.col(f"{into}.spans")))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of each document or piece of one."""
    return packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("packing", pack_bins),
]

#: SQL has no compression, sketches or message passing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of the documents in a folder. Each stage's result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_folder(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Scan of page text for phrases that make a document unacceptable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerproof.config import DEFAULTS, INJECTION_PHRASES, SQL_PHRASES, Settings

PHRASES = INJECTION_PHRASES + SQL_PHRASES
MESSAGES = tuple(
    [f"document text contains suspicious phrase: '{p}'" for p in INJECTION_PHRASES]
    + [f"document text contains a SQL-injection-style pattern: '{p}'" for p in SQL_PHRASES]
)


def phrase_mask(text: Column) -> Column:
    """A BIGINT with bit i set when phrase i occurs, ignoring case.

    A mask is eight bytes wherever it is shuffled and `bit_or` merges the
    masks of many pages before the shuffle.
    """
    low = F.lower(text)
    mask = F.lit(0).cast("bigint")
    for i, phrase in enumerate(PHRASES):
        mask = mask.bitwiseOR(
            F.when(F.contains(low, F.lit(phrase)), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
        )
    return mask


def _from_mask(mask: Column, values: tuple[str, ...]) -> Column:
    parts = [
        F.when(mask.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(v))
        for i, v in enumerate(values)
    ]
    return F.array_compact(F.array(*parts))


def hit_messages(mask: Column) -> Column:
    """The messages of a mask, in list order."""
    return _from_mask(mask, MESSAGES)


def hit_phrases(mask: Column) -> Column:
    return _from_mask(mask, PHRASES)


def scan_pages(pages: DataFrame) -> DataFrame:
    """Add `mask` to every page."""
    return pages.withColumn("mask", phrase_mask(F.col("text")))


def scan_documents(pages: DataFrame) -> DataFrame:
    """One row per document with the union of its pages' hits.

    Scanning page by page finds what a scan of the joined text finds: no phrase
    holds a line break, and page headers match nothing.
    """
    return scan_pages(pages.select("document_id", "text")).groupBy("document_id").agg(
        F.bit_or("mask").alias("mask")
    )


def rejected_documents(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Documents with any hit, with the error text of the failed job."""
    hit = scan_documents(pages).where(F.col("mask") != 0)
    text = F.concat(
        F.lit("blocked by security scan: "), F.array_join(hit_messages(F.col("mask")), "; ")
    )
    return hit.select(
        "document_id",
        F.lit("rejected").alias("status"),
        F.left(text, F.lit(settings.error_chars)).alias("last_error"),
    )


def safe_pages(pages: DataFrame) -> DataFrame:
    """Pages of the documents without any hit."""
    bad = scan_documents(pages).where(F.col("mask") != 0).select("document_id")
    return pages.join(bad, "document_id", "left_anti")


def hits_by_phrase(pages: DataFrame) -> DataFrame:
    """How many pages hold each phrase."""
    return (
        scan_pages(pages)
        .where(F.col("mask") != 0)
        .select(F.explode(hit_phrases(F.col("mask"))).alias("phrase"))
        .groupBy("phrase")
        .agg(F.count("*").alias("n_pages"))
    )

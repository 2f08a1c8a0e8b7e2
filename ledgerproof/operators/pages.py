"""Page text and word operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerproof.config import DEFAULTS, Settings
from ledgerproof.functions.text import strip_u
from ledgerproof.schemas import WORD


def route_text(candidates: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Choose the text layer when it is long enough, the OCR result otherwise.

    Takes `layer_text, layer_words, ocr_text, ocr_words`, gives `text_source,
    text, words`.
    """
    layer = strip_u(F.col("layer_text"))
    use_layer = F.coalesce(F.char_length(layer) >= settings.min_layer_chars, F.lit(False))
    return (
        candidates.withColumn("text_source", F.when(use_layer, "text_layer").otherwise("ocr"))
        .withColumn("text", F.when(use_layer, layer).otherwise(strip_u(F.col("ocr_text"))))
        .withColumn("words", F.when(use_layer, F.col("layer_words")).otherwise(F.col("ocr_words")))
        .drop("layer_text", "layer_words", "ocr_text", "ocr_words")
    )


def layer_words(raw: Column, settings: Settings = DEFAULTS) -> Column:
    """Raw text-layer words in reading order and image pixels.

    `raw` is an array of struct(x0, y0, x1, y1, text, block, line, word_no).
    """
    scale = settings.image_dpi / settings.points_dpi
    keyed = F.transform(
        raw,
        lambda w: F.struct(
            w["block"].alias("block"), w["line"].alias("line"), w["word_no"].alias("word_no"),
            F.struct(
                w["text"].alias("text"),
                F.array(*[w[c] * F.lit(scale) for c in ("x0", "y0", "x1", "y1")]).alias("bbox"),
            ).alias("word"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["word"]).cast(f"array<{WORD}>")


def ocr_words(tokens: Column) -> Column:
    """OCR tokens stripped, blanks dropped, as corner boxes.

    `tokens` is an array of struct(text, left, top, width, height).
    """
    kept = F.filter(
        F.transform(
            tokens,
            lambda t: F.struct(
                strip_u(t["text"]).alias("text"),
                F.array(
                    t["left"].cast("double"), t["top"].cast("double"),
                    (t["left"] + t["width"]).cast("double"),
                    (t["top"] + t["height"]).cast("double"),
                ).alias("bbox"),
            ),
        ),
        lambda w: w["text"] != "",
    )
    return kept.cast(f"array<{WORD}>")


def document_stats(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(
        F.count("*").alias("page_count"),
        F.bool_or(F.col("text_source") == "ocr").alias("used_ocr"),
    )


def text_parts(pages: DataFrame) -> DataFrame:
    """Add the `part` a page adds to its document's text.

    The parts of a document in page order, joined by one blank line, are its
    text; consumers that can stream need no document-sized value.
    """
    header = F.concat(
        F.lit("--- Page "), F.col("page_no"), F.lit(" ("), F.col("text_source"), F.lit(") ---\n")
    )
    return pages.withColumn("part", F.concat(header, F.col("text")))


def _assemble(pages: DataFrame, part: Column, out: str) -> DataFrame:
    """Join all parts of each document in page order. The group is one document."""
    grouped = pages.groupBy("document_id").agg(
        F.collect_list(F.struct("page_no", part.alias("part"))).alias("parts")
    )
    joined = F.array_join(F.transform(F.array_sort("parts"), lambda p: p["part"]), "\n\n")
    return grouped.select("document_id", joined.alias(out))


def document_text(pages: DataFrame) -> DataFrame:
    """The text shown to the extraction model, one row per document."""
    return _assemble(text_parts(pages), F.col("part"), "document_text")


def classify_input(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The text shown to the page classifier.

    The classifier is by design shown the first `classify_chars` characters of
    each page; no other step shortens text.
    """
    part = F.concat(
        F.lit("--- Page "), F.col("page_no"), F.lit(" ---\n"),
        F.left(F.col("text"), F.lit(settings.classify_chars)),
    )
    return _assemble(pages, part, "classify_text")


def own_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages inside each document's own range (all pages when it has none)."""
    ranges = documents.select(F.col("id").alias("document_id"), "page_start", "page_end")
    inside = F.col("page_start").isNull() | F.col("page_no").between(
        F.col("page_start"), F.col("page_end")
    )
    return pages.join(ranges, "document_id").where(inside).drop("page_start", "page_end")

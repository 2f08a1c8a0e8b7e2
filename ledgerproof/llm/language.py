"""Language identification by compression.

Each language has a raw-content Zstandard dictionary made of sample texts. A text is compressed
with every dictionary, and the language whose dictionary gives the smallest result is its
language; where the runner-up is nearly as small, the answer is marked as rejected.

Only letters count: a text is reduced to its lower-case words, and compressed whole, in blocks, so
that the dictionary matters throughout a long text.

Defined cases: a null text or one without a letter is `und` with score 0 and rejected; without any
labelled row every text is `und`; ties go to the language that sorts first and are rejected; rows
with a null id are classified as well (their id counts as the empty string); repeated rows are
classified alike; an empty table gives an empty result; other columns pass or are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerproof.llm.common import table, with_python

LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Options:
    """Training is bounded per language: the `sample_rows` labelled texts with the smallest hashes,
    copies counting once, `excerpt` characters of each, `dictionary` bytes in all. Texts are compressed in blocks
    of `block` bytes. An answer is rejected when the runner-up is less than `margin` larger."""

    sample_rows: int = 200
    excerpt: int = 3000
    dictionary: int = 1 << 16
    block: int = 1024
    level: int = 5
    margin: float = 0.015


DEFAULT = Options()


def plain(text: str) -> bytes:
    """The lower-case words of a text, with a blank between them."""
    return " ".join(LETTERS.findall(text.lower())).encode()


def held_out(doc_id: Column) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 5 == 0


def learned(labelled: DataFrame, options: Options = DEFAULT) -> dict[str, bytes]:
    """The dictionary of each language, from rows `text, lang`. The sample is bounded per language,
    however often a text or an id stands, so the driver gets `sample_rows` excerpts per language."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", F.substring("text", 1, options.excerpt).alias("text")
    ).withColumn("h", F.xxhash64("text"))
    spread = Window.partitionBy("lang").orderBy("h")
    chosen = usable.select("lang", "h").distinct().withColumn(
        "n", F.row_number().over(spread)
    ).where(F.col("n") <= options.sample_rows).drop("n")
    rows = usable.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(
        F.min("text").alias("text")
    ).collect()
    samples: dict[str, dict] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.h)):
        words = plain(row.text)
        if any(c.isalpha() for c in row.text):
            samples.setdefault(row.lang, {})[words] = None  # copies count once
    return {
        lang: b"\n".join(texts)[:options.dictionary] for lang, texts in sorted(samples.items())
    }


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], options: Options):
        self.options = options
        self.compressors = []
        for lang, content in sorted(dictionaries.items()):
            shared = zstandard.ZstdCompressionDict(
                content, dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            shared.precompute_compress(level=options.level)
            self.compressors.append((lang, zstandard.ZstdCompressor(
                level=options.level, dict_data=shared, write_checksum=False,
                write_content_size=False, write_dict_id=False,
            )))

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the answer is rejected."""
        if not text or not self.compressors or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        data, block = plain(text), self.options.block
        blocks = [data[k:k + block] for k in range(0, len(data), block)]
        sizes = sorted(
            (sum(len(c.compress(part)) for part in blocks), lang) for lang, c in self.compressors
        )
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        (best, lang), (second, _) = sizes[:2]
        margin = (second - best) / second
        return lang, min(1.0, margin), margin < self.options.margin


def classified(
    docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", into: str = "language",
    options: Options = DEFAULT,
) -> DataFrame:
    """`docs` with the struct column `into`: `lang_pred, score, rejected`."""
    models: list[Classifier] = []

    def answer(texts):
        if not models:
            models.append(Classifier(dictionaries, options))
        found = [models[0].classify(t) for t in texts]
        langs, scores, rejected = zip(*found) if found else ((), (), ())
        return [
            pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
            pa.array(rejected, pa.bool_()),
        ]

    return with_python(
        docs, text, into, "lang_pred string, score double, rejected boolean", answer
    )


def language_id(docs: DataFrame, options: Options = DEFAULT, into: str = "language") -> DataFrame:
    """`docs` classified by dictionaries learned from those of its own labelled rows that are not
    held out."""
    training = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")))
    return classified(docs, learned(training, options), into=into, options=options)


def op2_compression_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = classified(
        docs.select("doc_id", "text"), learned(docs.where(~held_out(F.col("doc_id"))))
    )
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred",
        "language.score", "language.rejected",
    )


QUERIES = {"op2_compression_language": op2_compression_language}

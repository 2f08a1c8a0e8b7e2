"""Importance resampling towards a target collection, over hashed word n-grams.

A 256-byte table turns the UTF-8 bytes of a text into lower-case words and blanks (ASCII letters are
lowered; ASCII characters other than letters and digits separate; all bytes from 0x80 stay), and
`bytes.split` yields the words. The CRC-32 of a run of words is chained: the checksum of the run so
far is the seed for the blank and the next word. Its remainder is the feature's bucket, and one
Counter per task, at most `buckets` entries, adds up the features of both collections.

A bucket's gain is the logarithm of its smoothed share of the target over its share of the corpus; a
document's weight is the mean gain of its features. With Gumbel noise from a hash of the document's
id added to the weight, the highest scores are a draw without replacement.

Scale: texts are read twice and never shuffled. Only bucket counts and one narrow row per document
are. The gains are at most `buckets` numbers, so the driver may hold them. Ranks come from a
distributed sort and the sizes of its partitions, not from one global window.

Defined cases: a text that is null or has no word has no feature and weight 0; a null id is hashed as
an empty one and comes last in a tie; rows that tie in score and id are ranked in any order; with no
target text all gains still follow the formula; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerproof.llm.common import staged, table

# Every separator becomes a blank; A-Z become a-z; what stays is a word byte.
WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32
    for b in range(256)
)


@dataclass(frozen=True)
class Options:
    """Runs of 1 to `longest` words are features. `percent` of the documents with at least
    `least_words` words are drawn. `seed` chooses the noise. `piece`: bytes split at once."""

    longest: int = 2
    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: int = 7
    piece: int = 1 << 20


DEFAULT = Options()


def pieces(text: str | None, size: int):
    """The words of a text as bytes, in lists from about `size` bytes each."""
    plain = (text or "").encode().translate(WORDS)
    start = 0
    while start < len(plain):
        end = plain.find(b" ", start + size) if start + size < len(plain) else -1
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def checksums(text: str | None, options: Options = DEFAULT):
    """Yields `(n_words, sums)` per piece of a text: its words, and the CRC-32 of each run of words
    that ends in it."""
    tails: list[list[int]] = [[] for _ in range(options.longest - 1)]
    for words in pieces(text, options.piece):
        runs = list(map(crc32, words))
        sums = list(runs)
        for k, tail in enumerate(tails):
            # The runs of k + 1 words before each word; the last one waits for the next piece.
            seeds = tail + runs
            tails[k] = seeds[-1:]
            ends = words[len(words) + 1 - len(seeds):] if seeds else []
            runs = list(map(crc32, ends, map(crc32, repeat(b" "), seeds)))
            sums += runs
        yield len(words), sums


def bucket_counts(texts: DataFrame, text: str = "text", options: Options = DEFAULT) -> DataFrame:
    """`bucket, n` over all features of all texts."""

    def run(batches):
        counts = Counter()
        for batch in batches:
            for value in batch.column(0):
                for _, sums in checksums(value.as_py(), options):
                    counts.update((np.array(sums, np.int64) % options.buckets).tolist())
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array(counts.keys(), pa.int32()), "n": pa.array(counts.values(), pa.int64())}
        )

    return texts.select(F.col(text).alias("t")).mapInArrow(run, "bucket int, n long").groupBy(
        "bucket"
    ).agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, options: Options = DEFAULT) -> list[int]:
    """The gain of each bucket, from the counts of corpus and target."""
    s, t = (dict(c.collect()) for c in (corpus, target))  # at most `buckets` rows each
    all_s, all_t, m = float(sum(s.values())), float(sum(t.values())), options.buckets
    return [
        floor(1000 * log(((t.get(b, 0) + 1.0) * (all_s + m)) / ((s.get(b, 0) + 1.0) * (all_t + m))))
        for b in range(m)
    ]


def weighted(
    docs: DataFrame, gain: list[int], doc_id: str = "doc_id", text: str = "text",
    options: Options = DEFAULT,
) -> DataFrame:
    """`doc_id, n_words, n_features, weight` of each row."""
    schema = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    by_bucket = np.array(gain, np.int64)

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                n_words = n_features = total = 0
                for words, sums in checksums(value.as_py(), options):
                    n_words, n_features = n_words + words, n_features + len(sums)
                    total += int(by_bucket[np.array(sums, np.int64) % options.buckets].sum())
                rows.append((n_words, n_features, total // n_features if n_features else 0))
            columns = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, columns)],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    kind = schema.schema["doc_id"].dataType.simpleString()
    return schema.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def scored(weights: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """With `score`: the weight and Gumbel noise from a hash of the id."""
    name = F.concat(F.lit(f"{options.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weights.withColumn("score", (F.col("weight") + noise).cast("long"))


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """`rows` with `place`, 1 for the first in the given order.

    Sorted rows are numbered within their partition and written; the sizes of the partitions, one
    row each, give every partition the number of rows before it.
    """
    numbered = staged(rows.orderBy(*order).withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("m", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("size")).collect()
    before, starts = 0, {}
    for row in sorted(sizes):  # one row per partition of the sort
        starts[row["part"]] = before - (row["part"] << 33) + 1
        before += row["size"]
    lookup = rows.sparkSession.createDataFrame(
        list(starts.items()) or [(0, 0)], "part long, start long"
    )
    return numbered.withColumn("part", part).join(F.broadcast(lookup), "part").withColumn(
        "place", F.col("m") + F.col("start")
    ).drop("m", "part", "start")


def resampled(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text",
    target_text: str = "text", options: Options = DEFAULT,
) -> DataFrame:
    """`doc_id, n_words, n_features, weight, score, rank`, one row per row of `docs`. `rank` is null
    for documents that aren't drawn."""
    gain = gains(
        bucket_counts(docs, text, options), bucket_counts(target, target_text, options), options
    )
    scores = staged(scored(weighted(docs, gain, doc_id, text, options), options))
    long_enough = F.col("n_words") >= options.least_words
    drawn = scores.where(long_enough).count() * options.percent // 100
    order = [long_enough.desc(), F.desc("score"), F.asc_nulls_last("doc_id"), "row"]
    rows = scores.withColumn("row", F.monotonically_increasing_id())
    return ranked(rows, order).withColumn(
        "rank", F.when(F.col("place") <= drawn, F.col("place"))
    ).drop("row", "place")


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampled(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    ).drop("n_words")


QUERIES = {"op13_importance_resampling": op13_importance_resampling}

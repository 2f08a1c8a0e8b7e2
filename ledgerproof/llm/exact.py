"""Exact duplicates by composable polynomial fingerprints.

Texts are equal when they are identical after each run of ASCII white space became one space. The
UTF-8 bytes of a normalised text are cut into chunks, and every chunk is hashed by itself: the value
of a polynomial at a fixed base, modulo two primes. Fingerprints compose: for a text of two parts,
h(a + b) = h(a) * base^len(b) + h(b). A chunk's hash is shifted by the bytes that follow it, so the
chunks of one huge document are hashed by many tasks and their shifted hashes are just added up.

Documents with equal fingerprints and lengths are then compared with the group's first document,
chunk by chunk, on the bytes themselves. What differs is grouped again without the documents that
are settled, until nothing differs, so a collision costs a round and never a wrong group.

Scale: fingerprints are grouped on narrow rows with partial aggregation. The texts of repeated
documents meet their group's first document in shares of at most `share` documents, each with its
own copy of the first document's chunks, so a group of any size is spread over many tasks. No task
holds more than the chunks of a batch. Normalised texts are written once to the shared folder.

Defined cases: a null text equals an empty one; a text of white space only is one space and not
empty; a null id comes after all others; of repeated rows with the smallest id one row stays; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerproof.llm.common import WORD_GAP, fresh_folder, staged, table


@dataclass(frozen=True)
class Options:
    """`chunk`: bytes that are hashed and compared at once, at most 2^24. `primes`: the moduli, below
    2^31, with a base each. `share`: documents of one group that meet one copy of its first one."""

    chunk: int = 1 << 16
    primes: tuple[int, ...] = (2147483647, 2147483629)
    bases: tuple[int, ...] = (1103515245, 1664525233)
    share: int = 256


DEFAULT = Options()


def prints(options: Options) -> list[str]:
    return [f"h{k}" for k in range(len(options.primes))]


def powers(base: int, prime: int, count: int) -> np.ndarray:
    """base^0 .. base^(count - 1) modulo the prime, by doubling."""
    found = np.ones(1, np.int64)
    while len(found) < count:
        found = np.concatenate([found, found * pow(base, len(found), prime) % prime])
    return found[:count]


def chunk_hashes(blob: np.ndarray, ends: np.ndarray, base: int, prime: int, table: np.ndarray):
    """The hash of each chunk; chunk k is the bytes of `blob` up to `ends[k]` from the end before.

    A byte counts one more than its value, so zero bytes count too. Sums stay below 2^63 for chunks
    of up to 2^24 bytes.
    """
    starts = np.concatenate([[0], ends[:-1]])
    held = ends > starts
    out = np.zeros(len(ends), np.int64)
    if held.any():
        behind = np.repeat(ends, ends - starts) - 1 - np.arange(len(blob))
        terms = (blob.astype(np.int64) + 1) * table[behind]
        out[held] = np.add.reduceat(terms, starts[held]) % prime
    return out


def hashed_chunks(chunks: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """The shifted hashes of each chunk, which add up to the fingerprint of its text.

    `chunks` has `chunk binary, behind long` (the bytes of the text behind the chunk) as its last
    columns; the others stay.
    """
    names = prints(options)
    kept = chunks.columns[:-2]

    def run(batches):
        tables = [powers(b, p, options.chunk) for b, p in zip(options.bases, options.primes)]
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                values = part.column("chunk").to_pylist()
                blob = np.frombuffer(b"".join(values), np.uint8)
                ends = np.cumsum([len(v) for v in values])
                behind = part.column("behind").to_pylist()
                sums = []
                for base, prime, power in zip(options.bases, options.primes, tables):
                    found = chunk_hashes(blob, ends, base, prime, power)
                    shift = np.array([pow(base, n, prime) if n else 1 for n in behind], np.int64)
                    sums.append(pa.array(found * shift % prime))
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, kept), *sums], [*kept, *names]
                )

    return chunks.mapInArrow(run, StructType(
        [*chunks.schema.fields[:-2], *[StructField(name, LongType()) for name in names]]
    ))


def chunks_of(texts: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """One row per chunk of each text: its other columns, `k`, `chunk` and `behind`."""
    size = options.chunk
    last = F.greatest(F.lit(0), F.expr(f"(n_bytes - 1) div {size}").cast("int"))
    other = [c for c in texts.columns if c != "bytes"]
    return texts.withColumn("k", F.explode(F.sequence(F.lit(0), last))).select(
        *other, "k", F.expr(f"substring(bytes, k * {size} + 1, {size})").alias("chunk"),
        F.greatest(F.lit(0), F.col("n_bytes") - (F.col("k") + 1).cast("long") * size).alias("behind"),
    )


def normalised_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", options: Options = DEFAULT
) -> DataFrame:
    """`row, doc_id, sha256, n_bytes, bytes` of each row, written to the shared folder."""
    spark = docs.sparkSession
    path = fresh_folder(spark, "normalised")
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WORD_GAP, " ")
    docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
        plain.cast("binary").alias("bytes"),
    ).select(
        "row", "doc_id", F.sha2("bytes", 256).alias("sha256"),
        F.octet_length("bytes").cast("long").alias("n_bytes"), "bytes",
    ).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def fingerprints(texts: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """The texts' fingerprints in place of their bytes. A text of one chunk is hashed where it lies; the
    chunks of longer ones are dealt out and only their hashes are brought together."""
    names = prints(options)
    long = F.col("n_bytes") > options.chunk
    # The whole text is the one chunk, so nothing is cut.
    short = hashed_chunks(texts.where(~long).withColumnRenamed("bytes", "chunk").withColumn(
        "behind", F.lit(0).cast("long")
    ), options)
    parts = hashed_chunks(
        chunks_of(texts.where(long).select("row", "n_bytes", "bytes"), options)
        .repartition("row", "k").select("row", "chunk", "behind"), options,
    )
    whole = parts.groupBy("row").agg(*[
        (F.sum(name) % prime).alias(name) for name, prime in zip(names, options.primes)
    ])
    return short.unionByName(texts.where(long).drop("bytes").join(whole, "row"))


def first_of(rows: DataFrame, key: list[str]) -> DataFrame:
    """Per group of more than one row: its number of rows and its first one."""
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(order).alias("first")).where(
        F.col("n") > 1
    ).select(*key, "n", F.col("first.row").alias("leader"))


def compared(texts: DataFrame, members: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """`row, leader, equal` of each member that isn't the leader itself.

    `members` has `row, leader, n`. A group of n rows is cut into shares; the leader's chunks are
    copied once for each share, and every share is compared with its copy. The rows of one share and
    chunk number are at most about `share`.
    """
    shares = F.expr(f"cast((n - 1) div {options.share} as int)") + 1
    of_leader = F.col("row") == F.col("leader")
    own = F.pmod(F.xxhash64("row"), shares).cast("int")
    found = chunks_of(
        texts.select("row", "n_bytes", "bytes").join(members, "row").withColumn(
            "part", F.explode(F.when(of_leader, F.sequence(F.lit(0), shares - 1)).otherwise(F.array(own)))
        ), options,
    )
    # Equal lengths have the same chunks, so the leader's is always there.
    expected = F.max(F.when(of_leader, F.col("chunk"))).over(
        Window.partitionBy("leader", "part", "k")
    )
    return found.select(
        "row", "leader", "part", "k", "chunk", expected.alias("expected")
    ).where(~of_leader).groupBy("row", "leader").agg(
        F.every(F.col("chunk") == F.col("expected")).alias("equal")
    )


def exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", options: Options = DEFAULT
) -> DataFrame:
    """`row, doc_id, keep_id, group_size, kept, text_sha256`, one row per row of `docs`."""
    texts = normalised_texts(docs, doc_id, text, options)
    narrow = staged(fingerprints(texts, options))
    key = [*prints(options), "n_bytes"]
    open_rows, settled = narrow.select("row", "doc_id", *key), []
    while True:
        members = staged(
            open_rows.join(first_of(open_rows, key), key).select("row", "doc_id", *key, "leader", "n")
        )
        verdicts = staged(compared(texts, members.select("row", "leader", "n"), options))
        settled.append(verdicts.where("equal").select("row", "leader"))
        differing = verdicts.where(~F.col("equal"))
        if differing.isEmpty():
            break
        open_rows = members.drop("leader", "n").join(differing.select("row"), "row", "left_semi")
    followers = reduce(DataFrame.unionByName, settled)
    groups = followers.groupBy("leader").agg((F.count("*") + 1).alias("group_size")).join(
        narrow.select(F.col("row").alias("leader"), F.col("doc_id").alias("keep_id")), "leader"
    )
    place = followers.unionByName(groups.select(F.col("leader").alias("row"), "leader")).join(
        groups, "leader"
    )
    single = F.col("leader").isNull()
    return narrow.join(place, "row", "left").select(
        "row", "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("leader") == F.col("row"))).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def op12_polynomial_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents")).drop("row")


SQL = {"op12_polynomial_fingerprints": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST) AS row,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row = min(row) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t ORDER BY row)
"""}

QUERIES = {"op12_polynomial_fingerprints": op12_polynomial_fingerprints}

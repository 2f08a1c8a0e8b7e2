"""Token counts as rollups maintained by signed deltas.

An insert adds a document and its tokens to its (source, language, tokenizer version), a delete
takes them away, and a revised count adds the difference. Sums are additive, so a batch is reduced
to one small row per key before it is written, and totals are the sum over batches.

A batch is one folder of the delta table and is replaced as a whole when it is committed again, also
by fewer rows or none: a replayed batch changes nothing, and a batch that died half-way is simply
repeated. `compact` adds up old batches into one, in a new table that knows how far it goes.

Defined cases: null source and language are keys of their own; a null text has no tokens; a null
document id is a document like any other; repeated rows count each; an empty batch leaves the totals
as they are; other columns are ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerproof.llm.common import fresh_folder, staged, table, words_of

KEYS = ("source", "lang", "version")
# Letters, numbers and other signs apart; written alike for Java and RE2.
PIECES = "[\\p{L}\\p{M}]+|\\p{N}+|[^\\p{L}\\p{M}\\p{N}\\x09-\\x0D\\x20]+"


def inserts(counted: DataFrame, tokens: str, version: str) -> DataFrame:
    """Deltas that add documents with their token counts."""
    return _signed(counted, version, F.lit(1), F.col(tokens))


def deletes(counted: DataFrame, tokens: str, version: str) -> DataFrame:
    """Deltas that take documents away."""
    return _signed(counted, version, F.lit(-1), -F.col(tokens))


def revisions(counted: DataFrame, before: str, after: str, version: str) -> DataFrame:
    """Deltas for documents whose count changes; the number of documents stays."""
    return _signed(
        counted.where(F.col(before) != F.col(after)), version, F.lit(0),
        F.col(after) - F.col(before),
    )


def _signed(counted: DataFrame, version: str, documents, tokens) -> DataFrame:
    return counted.select(
        "source", "lang", F.lit(version).alias("version"),
        documents.cast("long").alias("n_documents"), tokens.cast("long").alias("n_tokens"),
    )


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(
        F.sum("n_documents").alias("n_documents"), F.sum("n_tokens").alias("n_tokens")
    )


def commit(deltas: DataFrame, path: str, batch_id: int) -> None:
    """Reduce a batch and write it as its folder, replacing an earlier attempt. A batch that a
    compaction has taken in is left as it is."""
    if batch_id > compacted_up_to(deltas.sparkSession, path):
        # The folder itself is overwritten: a batch without rows replaces one with rows.
        summed(deltas).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def batches_of(spark: SparkSession, path: str) -> DataFrame:
    schema = "source STRING, lang STRING, version STRING, n_documents LONG, n_tokens LONG, batch_id LONG"
    return spark.read.schema(schema).parquet(path)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """`source, lang, version, n_documents, n_tokens` after all committed batches. Keys without
    documents and tokens are left out."""
    return summed(batches_of(spark, path)).where(
        (F.col("n_documents") != 0) | (F.col("n_tokens") != 0)
    )


def compact(spark: SparkSession, path: str, into: str, up_to: int) -> None:
    """Write the table anew to the folder `into`, the batches up to number `up_to` as one. It may be
    repeated when it died half-way; readers and writers change to the new table when it is done."""
    deltas = batches_of(spark, path)
    summed(deltas.where(F.col("batch_id") <= up_to)).withColumn(
        "batch_id", F.lit(up_to).cast("long")
    ).unionByName(deltas.where(F.col("batch_id") > up_to)).write.mode("overwrite").partitionBy(
        "batch_id"
    ).parquet(into)
    spark.range(up_to, up_to + 1).write.mode("overwrite").parquet(f"{into}/_compacted")


def compacted_up_to(spark: SparkSession, path: str) -> int:
    """The last batch that a compaction has taken in; -1 for a table that was never compacted."""
    try:
        return spark.read.schema("id LONG").parquet(f"{path}/_compacted").first()["id"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1


def counted_documents(docs: DataFrame) -> DataFrame:
    """Token counts of each document by each tokenizer version, and what makes it a copy."""
    text = F.coalesce("text", F.lit(""))
    lines = F.array_distinct(F.split(F.col("t"), "\n"))
    return docs.select("doc_id", "source", "lang", text.alias("t")).select(
        "doc_id", "source", "lang",
        F.size(words_of(F.col("t"))).cast("long").alias("words"),
        F.size(words_of(F.array_join(lines, "\n"))).cast("long").alias("line_words"),
        F.regexp_count("t", F.lit(PIECES)).cast("long").alias("pieces"),
        F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"),
    )


def copies(counted: DataFrame) -> DataFrame:
    """The documents whose text a document with a smaller id has too."""
    first = counted.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("n")
    ).where(F.col("n") > 1)
    return counted.join(first, "digest").where(F.col("doc_id") > F.col("first"))


def op7_token_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Four batches over all documents, the deletes and revisions committed twice: insert by two
    tokenizer versions, delete copies, count every repeated line of a document once."""
    path = fresh_folder(spark, "token-deltas")
    counted = staged(counted_documents(table(spark, folder, "documents")))
    gone = staged(copies(counted))
    commit(inserts(counted, "words", "words-1"), path, 1)
    commit(inserts(counted, "pieces", "pieces-1"), path, 2)
    for _ in range(2):
        commit(
            deletes(gone, "words", "words-1").unionByName(deletes(gone, "pieces", "pieces-1")),
            path, 3,
        )
        # A copy that is gone has no count to revise: its revision is taken back again.
        revised = revisions(counted, "words", "line_words", "words-1").unionByName(
            revisions(gone, "line_words", "words", "words-1")
        )
        commit(revised, path, 4)
    return totals(spark, path)


SQL = {"op7_token_rollup": r"""
WITH d AS (
  SELECT *, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), kept AS (
  SELECT source, lang, t FROM d WHERE doc_id = first OR doc_id IS NULL
), counted AS (
  SELECT source, lang, t, len(regexp_extract_all(array_to_string(list_distinct(
      string_split(t, chr(10))), chr(10)), '[^\x20\x09-\x0D]+')) AS words,
    len(regexp_extract_all(t, '[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\x09-\x0D\x20]+')) AS pieces
  FROM kept
), versions AS (
  SELECT source, lang, 'words-1' AS version, words AS n FROM counted
  UNION ALL SELECT source, lang, 'pieces-1', pieces FROM counted
)
SELECT source, lang, version, count(*) AS n_documents, sum(n)::BIGINT AS n_tokens
FROM versions GROUP BY ALL
"""}

QUERIES = {"op7_token_rollup": op7_token_rollup}

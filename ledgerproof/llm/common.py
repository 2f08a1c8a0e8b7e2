"""Helpers shared by the operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ledgerproof.session import dropping_shuffles, shared_folder, with_local_folder  # noqa: F401

# A word is a run of characters other than ASCII white space.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def staged(df: DataFrame) -> DataFrame:
    """`df` written once to the shared checkpoint folder.

    Cuts the lineage so that no branch is computed twice, and survives lost executors. The files are
    removed when nothing refers to them any more if the session was started with
    `spark.cleaner.referenceTracking.cleanCheckpoints`; else by who empties the folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(with_local_folder(df.sparkSession)))
    return df.checkpoint()


def staged_round(df: DataFrame) -> DataFrame:
    """`staged` for the rounds of a loop that joins what the round before it wrote.

    A checkpoint keeps the size that was estimated for its plan, and a join multiplies sizes: within
    some rounds that number has so many digits that it fills the driver's memory. Here it is dropped.
    """
    done = staged(df)
    rows, session = done._jdf.queryExecution().analyzed().rdd(), df.sparkSession._jsparkSession
    return DataFrame(session.internalCreateDataFrame(rows, done._jdf.schema(), False), df.sparkSession)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(with_local_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def batches(rows, size: int):
    """Lists of at most `size` consecutive items."""
    for start in range(0, len(rows), size):
        yield rows[start:start + size]


def with_python(df: DataFrame, column: str, into: str, schema: str, compute) -> DataFrame:
    """`df` with one more struct column `into`, computed from the text column in Python.

    `compute` gets a list of texts and returns an Arrow array per field of `schema`. Rows keep their
    other columns, so nothing is joined back. Arrow batches are cut again, to some megabytes each.
    """
    kind = StructType.fromDDL(schema)
    target = StructType([*df.schema.fields, StructField(into, kind)])
    at, limit = df.columns.index(column), 4 << 20

    def run(parts):
        for part in parts:
            texts = part.column(at)
            start = held = 0
            for k in range(part.num_rows):
                held += len(texts[k].as_py() or "") if limit < part.nbytes else 0
                if held >= limit:
                    yield extended(part.slice(start, k + 1 - start))
                    start, held = k + 1, 0
            if start < part.num_rows:
                yield extended(part.slice(start))

    def extended(part):
        fields = compute(part.column(at).to_pylist())
        struct = pa.StructArray.from_arrays(fields, names=kind.names)
        return pa.RecordBatch.from_arrays([*part.columns, struct], [*part.schema.names, into])

    return df.mapInArrow(run, target)

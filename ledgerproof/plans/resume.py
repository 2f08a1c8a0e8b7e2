"""A model stage that can be resumed.

Every call is a row of an answer table, under the digest of its request. The table is partitioned by
a bucket of the digest, and each bucket is asked and committed by itself: a run that dies has lost
one bucket's calls at most, and the next run asks only about requests without an answer. Calls that
fail are asked again when their delay has passed, with the delays of the job log, until the limit of
attempts; a request that never gets an answer stays in the table with its last error.

Equal requests are asked once. The table is read by bucket, so a bucket's run reads its own part only.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ledgerproof.config import DEFAULTS, Settings
from ledgerproof.operators.jobs import next_run_at

CALL = "digest string, attempt int, error string, asked_at timestamp"
NO_ANSWER = "the model gave no answer"


def with_digest(requests: DataFrame, buckets: int) -> DataFrame:
    """Adds `digest`, of all columns, and `bucket`."""
    text = F.to_json(F.struct(*requests.columns), {"ignoreNullFields": "false"})
    return requests.withColumn("digest", F.sha2(text, 256)).withColumn(
        "bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")
    )


def calls(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All calls in the table: `digest, attempt, error, asked_at, answer, bucket`."""
    full = f"{CALL}, answer struct<{_struct(schema)}>, bucket int"
    try:
        # The folder of a call's bucket is its partition; the one of its commit is not a column.
        return spark.read.schema(full).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def _struct(schema: str) -> str:
    return ", ".join(
        f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields
    )


def progress(made: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per request: whether it has an answer, its failed attempts, and when it may be asked again."""
    failed = F.col("error").isNotNull()
    return made.groupBy("bucket", "digest").agg(
        F.bool_or(~failed).alias("answered"),
        F.coalesce(F.max(F.when(failed, F.col("attempt"))), F.lit(0)).alias("attempts"),
        F.max(F.when(failed, F.col("asked_at"))).alias("failed_at"),
    ).withColumn("due", next_run_at(F.col("failed_at"), F.col("attempts"), settings))


def open_requests(
    requests: DataFrame, made: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """The requests that wait for an answer, with their next `attempt` and when it is `due`."""
    state = progress(made, settings)
    return requests.join(state, ["bucket", "digest"], "left").where(
        ~F.coalesce("answered", F.lit(False))
        & (F.coalesce("attempts", F.lit(0)) < settings.max_attempts)
    ).withColumn("attempt", F.coalesce("attempts", F.lit(0)) + 1).drop(
        "answered", "attempts", "failed_at"
    )


def _asking(model, columns: list[str], key: str, schema: StructType, rows: int):
    """The task that calls the model on batches of at most `rows` requests."""
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), rows):
                part = batch.iloc[start:start + rows].reset_index(drop=True)
                out = part[["digest", "attempt"]].assign(error=None, asked_at=pd.Timestamp.now("UTC"))
                try:
                    found = model(part[columns])
                except Exception as exc:  # noqa: BLE001 - a failed call is a row, to be asked again
                    out["error"] = str(exc)[:2000] or type(exc).__name__
                    found = pd.DataFrame(columns=names)
                answers = found.drop_duplicates(key).set_index(key, drop=False).to_dict("index")
                given = [answers.get(k) for k in part[key]]
                out["answer"] = [
                    {n: None if _missing(a[n]) else a[n] for n in names} if a else None for a in given
                ]
                gone = out["error"].isna() & pd.Series([a is None for a in given])
                out.loc[gone, "error"] = NO_ANSWER
                yield out

    return run


def _missing(value) -> bool:
    return value is None or value is pd.NA or isinstance(value, float) and value != value


def ask(
    requests: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], path: str, schema: str,
    key: str = "document_id", buckets: int = 16, rows: int = 100, settings: Settings = DEFAULTS,
    wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Ask the model about every request that the table at `path` has no answer to, and return the
    answers of all requests.

    `key` names the column that a request and its answer share. `requests` are read once for each
    bucket, so a caller that can should write them first.
    """
    spark, columns = requests.sparkSession, requests.columns
    kind = StructType.fromDDL(schema)
    asked = with_digest(requests, buckets).dropDuplicates(["bucket", "digest"])
    call = StructType([*StructType.fromDDL(CALL).fields, StructField("answer", kind)])
    while True:
        made = calls(spark, path, schema)
        todo = open_requests(asked, made, settings)
        # At most `buckets` rows.
        due = todo.groupBy("bucket").agg(F.min(F.coalesce("due", F.lit(0).cast("timestamp"))).alias("due"))
        soonest = {r["bucket"]: r["due"].timestamp() for r in due.collect()}
        if not soonest:
            break
        delay = min(soonest.values()) - time.time()
        if delay > 0:
            wait(delay)
        now = F.current_timestamp()
        for bucket in sorted(b for b, at in soonest.items() if at <= time.time()):
            part = open_requests(
                asked.where(F.col("bucket") == bucket), made.where(F.col("bucket") == bucket), settings
            ).where(F.coalesce(F.col("due") <= now, F.lit(True)))
            part.select(*columns, "digest", "attempt").mapInPandas(
                _asking(model, columns, key, kind, rows), call
            ).write.parquet(f"{path}/bucket={bucket}/commit-{uuid.uuid4().hex}")
    return answers_of(asked, calls(spark, path, schema))


def answers_of(asked: DataFrame, made: DataFrame) -> DataFrame:
    """The answer of each request that has one; the first, where a lost commit was repeated."""
    good = made.where(F.col("error").isNull()).groupBy("bucket", "digest").agg(
        F.min_by("answer", "asked_at").alias("answer")
    )
    return asked.select("bucket", "digest").join(good, ["bucket", "digest"]).select("answer.*")


def unanswered(
    requests: DataFrame, path: str, schema: str, buckets: int = 16, settings: Settings = DEFAULTS
) -> DataFrame:
    """The requests that were given up, with `attempts` and `error`."""
    made = calls(requests.sparkSession, path, schema)
    last = made.where(F.col("error").isNotNull()).groupBy("digest").agg(
        F.max_by("error", "attempt").alias("error")
    )
    return with_digest(requests, buckets).join(
        progress(made, settings).where(~F.col("answered") & (F.col("attempts") >= settings.max_attempts))
        .select("bucket", "digest", "attempts"), ["bucket", "digest"]
    ).join(last, "digest").select(*requests.columns, "attempts", "error")

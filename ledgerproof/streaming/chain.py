"""Stages that run as streams of their own and hand over committed batches.

A stage works on one batch of its predecessor at a time. It writes its tables for that batch under
`<root>/<stage>/<table>/batch=<n>`, and only when all of them are there a row to its `done` table,
which is the stream that the next stage reads. A batch keeps its number along the chain. A stage that
dies leaves no `done` row, so its batch is done again and its tables are replaced as a whole; a batch
that has a `done` row is never done twice. Queries can be stopped and started at any point.

A batch whose stage raises is tried again, with the delays of the job log, until the limit of
attempts; then its documents are `failed` with the error, and the batch goes no further.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ledgerproof.config import DEFAULTS, Settings
from ledgerproof.operators.jobs import follow_up_jobs

DONE = "batch bigint, failed boolean, finished_at timestamp"
FAILURES = "batch bigint, attempt int, error string, failed_at timestamp"
FAILED = "document_id string, status string, last_error string"
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """`run` gets the tables that the earlier stages wrote for a batch (the first stage gets the
    batch as `input`), and returns its own by name. One of them may be `documents`, with
    `document_id`: the documents that go on, for which the next stage is queued."""

    name: str
    run: Callable[[Tables], Tables]


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def written_before(spark: SparkSession, root: str, stage: str) -> bool:
    """Whether a stage has done a batch without giving it up."""
    return not _read(spark, f"{root}/{stage}/done", DONE).where(~F.col("failed")).isEmpty()


def batch_table(spark: SparkSession, root: str, stage: str, table: str) -> DataFrame:
    """A stage's table over all batches that it has done. `batch` is its last column."""
    done = _read(spark, f"{root}/{stage}/done", DONE).select("batch").distinct()
    rows = spark.read.parquet(f"{root}/{stage}/{table}")
    return rows.join(F.broadcast(done), "batch", "left_semi").select(
        *[c for c in rows.columns if c != "batch"], "batch"
    )


def _names(spark: SparkSession, root: str, stage: str, batch: int) -> list[str]:
    rows = _read(spark, f"{root}/{stage}/tables", "name string, batch bigint")
    return sorted(r["name"] for r in rows.where(F.col("batch") == batch).distinct().collect())


def _inputs(spark: SparkSession, root: str, stages: list[Stage], upto: int, batch: int) -> Tables:
    """What the stages before number `upto` wrote for a batch; later ones replace tables by name."""
    found: Tables = {}
    for stage in stages[:upto]:
        for name in _names(spark, root, stage.name, batch):
            found[name] = spark.read.parquet(f"{root}/{stage.name}/{name}/batch={batch}")
    return found


def _attempts(spark: SparkSession, root: str, stage: str, batch: int) -> int:
    rows = _read(spark, f"{root}/{stage}/failures", FAILURES)
    return rows.where(F.col("batch") == batch).count()


def _mark(spark: SparkSession, root: str, stage: str, batch: int, failed: bool) -> None:
    spark.range(1).select(
        F.lit(batch).cast("bigint").alias("batch"), F.lit(failed).alias("failed"),
        F.current_timestamp().alias("finished_at"),
    ).coalesce(1).write.mode("append").parquet(f"{root}/{stage}/done")


def do_batch(
    spark: SparkSession, root: str, stages: list[Stage], at: int, batch: int, inputs: Tables,
    settings: Settings = DEFAULTS, wait: Callable[[float], None] = time.sleep,
) -> None:
    """Do one stage for one batch, unless it is done."""
    stage, home = stages[at], f"{root}/{stages[at].name}"
    if not _read(spark, f"{home}/done", DONE).where(F.col("batch") == batch).isEmpty():
        return
    while True:
        try:
            tables = stage.run(inputs)
            if "documents" in tables:
                queued = tables["documents"].select("document_id", F.lit(stage.name).alias("stage"))
                tables = tables | {"jobs": follow_up_jobs(queued)}
            for name, rows in tables.items():
                rows.write.mode("overwrite").parquet(f"{home}/{name}/batch={batch}")
            spark.createDataFrame([(n,) for n in sorted(tables)], "name string").coalesce(
                1
            ).write.mode("overwrite").parquet(f"{home}/tables/batch={batch}")
            return _mark(spark, root, stage.name, batch, False)
        except Exception as exc:  # noqa: BLE001 - any failure counts as an attempt
            attempt = _attempts(spark, root, stage.name, batch) + 1
            error = str(exc)[: settings.error_chars]
            spark.createDataFrame([(batch, attempt, error)], "batch bigint, attempt int, error string") \
                .withColumn("failed_at", F.current_timestamp()).coalesce(1) \
                .write.mode("append").parquet(f"{home}/failures")
            if attempt >= settings.max_attempts:
                source = inputs.get("documents", inputs.get("input"))
                source.select("document_id").distinct().select(
                    "document_id", F.lit("failed").alias("status"), F.lit(error).alias("last_error")
                ).write.mode("overwrite").parquet(f"{home}/failed/batch={batch}")
                return _mark(spark, root, stage.name, batch, True)
            wait(settings.backoff_base_seconds * 2.0 ** (attempt - 1))


def failed_documents(spark: SparkSession, root: str, stages: list[Stage]) -> DataFrame:
    """`document_id, status, last_error, stage` of the batches that were given up."""
    found = [
        _read(spark, f"{root}/{s.name}/failed", FAILED).select(
            *[c.split(" ")[0] for c in FAILED.split(", ")]
        ).withColumn("stage", F.lit(s.name)) for s in stages
    ]
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def start_stage(
    spark: SparkSession, source: DataFrame | None, stages: list[Stage], at: int, root: str,
    available_now: bool = True, settings: Settings = DEFAULTS, batches: int = 4,
    wait: Callable[[float], None] = time.sleep,
) -> StreamingQuery:
    """Start one stage of the chain. The first one reads `source`, a stream; the others take up to
    about `batches` batches at once from their predecessor's `done` table."""
    if at == 0:
        rows = source
    else:
        home = f"{root}/{stages[at - 1].name}/done"
        if _read(spark, home, DONE).isEmpty():
            # A stream can't start on a folder that isn't there yet.
            spark.createDataFrame([], DONE).write.mode("append").parquet(home)
        rows = spark.readStream.schema(DONE).option("maxFilesPerTrigger", batches).parquet(home)

    def first(batch: DataFrame, batch_id: int) -> None:
        do_batch(batch.sparkSession, root, stages, 0, batch_id, {"input": batch}, settings, wait)

    def later(done: DataFrame, batch_id: int) -> None:
        session = done.sparkSession
        # A handful of batch numbers.
        for row in done.where(~F.col("failed")).select("batch").distinct().orderBy("batch").collect():
            inputs = _inputs(session, root, stages, at, row["batch"])
            do_batch(session, root, stages, at, row["batch"], inputs, settings, wait)

    writer = rows.writeStream.foreachBatch(later if at else first).option(
        "checkpointLocation", f"{root}/{stages[at].name}/checkpoint"
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_chain(
    spark: SparkSession, source: DataFrame, stages: list[Stage], root: str, **options
) -> None:
    """Run every stage on what is there, in order, and come back when all of it is through."""
    for at in range(len(stages)):
        start_stage(spark, source, stages, at, root, **options).awaitTermination()

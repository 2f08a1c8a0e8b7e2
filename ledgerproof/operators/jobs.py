"""Questions about the job log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerproof.config import DEFAULTS, JOB_STAGES, Settings

NEXT_STAGE = dict(zip(JOB_STAGES, JOB_STAGES[1:]))


def claimable(now: Column, settings: Settings = DEFAULTS) -> Column:
    """Queued and due, or processing under a lock that has gone stale."""
    stale = now - F.make_interval(mins=F.lit(settings.stale_lock_minutes))
    due = (F.col("status") == "queued") & (F.col("next_run_at") <= now)
    abandoned = (F.col("status") == "processing") & (F.col("locked_at") < stale)
    return F.coalesce(due, F.lit(False)) | F.coalesce(abandoned, F.lit(False))


def claimable_jobs(jobs: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """The jobs a worker may take at `now`, oldest first."""
    return jobs.where(claimable(now, settings)).orderBy("created_at", "id")


def backoff_seconds(attempts: Column, settings: Settings = DEFAULTS) -> Column:
    """base, 2*base, 4*base, ... after the first, second, third failure."""
    doublings = F.greatest(attempts - 1, F.lit(0))
    return (F.lit(settings.backoff_base_seconds) * F.pow(F.lit(2.0), doublings)).cast("bigint")


def next_run_at(failed_at: Column, attempts: Column, settings: Settings = DEFAULTS) -> Column:
    return failed_at + F.make_interval(secs=backoff_seconds(attempts, settings))


def fold_failures(failures: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """State of every failed (document_id, stage) after its failures.

    `failures` has `document_id, stage, failed_at, event_id, rejected`. A job ends at its first
    security rejection, which is no attempt, or at the failure that reaches `max_attempts`,
    whichever comes first; what is logged after that is not counted. The rank filter runs before
    the shuffle, so a job with very many failure rows sends a handful per task.
    """
    key = ["document_id", "stage"]
    order = Window.partitionBy(*key).orderBy("failed_at", "event_id")
    at = F.struct("failed_at", "event_id")
    counted = (
        failures.where(~F.col("rejected"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= settings.max_attempts)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(at)).alias("first"))
    )
    refused = failures.where("rejected").groupBy(*key).agg(F.min(at).alias("rejected_at"))
    before = F.filter(
        "first", lambda x: F.col("rejected_at").isNull() | (x < F.col("rejected_at"))
    )
    both = counted.join(refused, key, "full_outer").withColumn("counted", before)
    attempts = F.greatest(F.coalesce(F.size("counted"), F.lit(0)), F.lit(0))
    dead = attempts >= settings.max_attempts
    refused_first = F.col("rejected_at").isNotNull() & ~dead
    last = F.get("counted", attempts - 1)["failed_at"]
    return both.select(
        *key,
        attempts.alias("attempts"),
        F.when(refused_first | dead, "failed").otherwise("queued").alias("job_status"),
        F.when(refused_first, "rejected").when(dead, "failed").alias("document_status"),
        F.when(~refused_first & ~dead, next_run_at(last, attempts, settings)).alias("next_run_at"),
    )


def dead_letters(folded: DataFrame) -> DataFrame:
    return folded.where(F.col("job_status") == "failed")


def follow_up_jobs(done: DataFrame) -> DataFrame:
    """The jobs to queue after finished ones; the last stage has none."""
    following = F.create_map(*[F.lit(x) for pair in NEXT_STAGE.items() for x in pair])
    return (
        done.withColumn("stage", F.try_element_at(following, F.col("stage")))
        .where(F.col("stage").isNotNull())
        .withColumn("status", F.lit("queued"))
    )


def stage_progress(jobs: DataFrame) -> DataFrame:
    """Per document the start of each stage and the seconds until the next.

    Stages are few and fixed, so this is one aggregate, not a window over all
    of a document's jobs.
    """
    starts = jobs.groupBy("document_id").agg(
        *[F.min(F.when(F.col("stage") == s, F.col("created_at"))).alias(s) for s in JOB_STAGES],
        F.count_if(F.col("status") == "done").alias("n_done"),
    )
    durations = [
        F.timestamp_diff("SECOND", F.col(a), F.col(b)).alias(f"{a}_seconds")
        for a, b in NEXT_STAGE.items()
    ]
    reached = F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in reversed(JOB_STAGES)])
    return starts.select("document_id", reached.alias("reached"), "n_done", *durations)


def orphan_jobs(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Jobs whose document does not exist, as they end up."""
    ids = documents.select(F.col("id").alias("document_id"))
    return (
        jobs.join(ids, "document_id", "left_anti")
        .withColumn("status", F.lit("failed"))
        .withColumn("last_error", F.lit("document not found"))
    )

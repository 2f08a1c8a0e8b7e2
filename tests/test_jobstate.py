import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerproof.config import Settings
from ledgerproof.operators.jobs import fold_failures
from ledgerproof.streaming import jobstate

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    for key, value in jobstate.STORE.items():
        spark.conf.set(key, value)
    yield
    for key in jobstate.STORE:
        spark.conf.unset(key)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def states(df):
    return {(r.document_id, r.stage): r for r in df.collect()}


def folded(spark, events):
    failures = spark.createDataFrame(events, jobstate.EVENTS).where("kind in ('failed', 'rejected')")
    rows = fold_failures(failures.select(
        "document_id", "stage", F.col("at").alias("failed_at"), "event_id",
        (F.col("kind") == "rejected").alias("rejected"),
    )).collect()
    return {(r.document_id, r.stage): (r.attempts, r.job_status, r.document_status, r.next_run_at) for r in rows}


def test_batches_in_any_order_equal_the_fold(spark, tmp_path):
    rng = random.Random(11)
    events = [
        (f"d{rng.randrange(9)}", rng.choice(["parse", "extract"]), n, at(rng.randrange(5000)),
         "rejected" if rng.random() < 0.08 else "failed", at(0)) for n in range(70)
    ]
    source, path, checkpoint = (str(tmp_path / p) for p in ("in", "out", "cp"))
    shuffled = rng.sample(events, len(events))
    for k in range(0, len(shuffled), 18):  # a new query from the checkpoint for every batch
        spark.createDataFrame(shuffled[k:k + 18], jobstate.EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(jobstate.EVENTS).parquet(source)
        jobstate.job_state_stream(stream, path, checkpoint).awaitTermination()
    found = states(jobstate.current_jobs(spark, path))
    expected = folded(spark, events)
    assert {k: (r.attempts, r.job_status, r.document_status, r.next_run_at) for k, r in found.items()} == expected
    once = states(jobstate.job_states(spark.createDataFrame(events, jobstate.EVENTS)))
    assert {k: (r.attempts, r.job_status, r.document_status, r.next_run_at) for k, r in once.items()} == expected


def test_stale_locks_are_given_up_after_a_restart(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / p) for p in ("in", "out", "cp"))

    def feed(logged, *events):
        rows = [(*e, at(logged)) for e in events]
        spark.createDataFrame(rows, jobstate.EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(jobstate.EVENTS).parquet(source)
        jobstate.job_state_stream(stream, path, checkpoint).awaitTermination()
        return states(jobstate.current_jobs(spark, path))

    got = feed(10, ("old", "parse", 1, at(0), "locked"), ("fine", "parse", 3, at(0), "locked"),
               ("fine", "parse", 4, at(9), "done"))
    assert got["old", "parse"].job_status == "processing"
    got = feed(700, ("new", "parse", 2, at(690), "locked"), ("other", "parse", 5, at(1), "locked"),
               ("other", "parse", 6, at(2), "failed"))
    old = got["old", "parse"]
    assert (old.job_status, old.reclaimed, old.next_run_at) == ("queued", True, at(600))
    assert got["new", "parse"].job_status == "processing" and got["fine", "parse"].job_status == "done"
    assert (got["other", "parse"].attempts, got["other", "parse"].next_run_at) == (1, at(12))
    # The next owner of the reclaimed job finishes it; failures before are kept.
    got = feed(710, ("old", "parse", 7, at(700), "locked"), ("old", "parse", 8, at(705), "failed"))
    assert (got["old", "parse"].job_status, got["old", "parse"].attempts) == ("queued", 1)
    got = feed(810, ("old", "parse", 9, at(800), "locked"), ("old", "parse", 10, at(805), "done"))
    assert (got["old", "parse"].job_status, got["old", "parse"].reclaimed) == ("done", False)


def test_state_stays_small_and_limits_hold(spark):
    events = [("d", "parse", n, at(n), "failed", at(n)) for n in range(500)] * 2
    (row,) = jobstate.job_states(spark.createDataFrame(events, jobstate.EVENTS), Settings(max_attempts=3)).collect()
    assert (row.attempts, row.job_status, row.document_status) == (3, "failed", "failed")

"""The job log at many times equals the question asked for each time."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerproof.operators import jobs, timeline

START = dt.datetime(2024, 1, 1)
LOG = (
    "id string, document_id string, stage string, status string, locked_at timestamp_ntz, "
    "next_run_at timestamp_ntz, created_at timestamp_ntz"
)


def at(minutes, micros=0):
    return START + dt.timedelta(minutes=minutes, microseconds=micros)


def log(spark, n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        status = rng.choice(["queued", "processing", "done", "failed", None])
        made = rng.randrange(600)
        rows.append((
            f"j{k:03d}", f"d{rng.randrange(5)}", rng.choice(["parse", "extract"]), status,
            rng.choice([at(made), None]), rng.choice([at(made + rng.randrange(90)), None]), at(made),
        ))
    return spark.createDataFrame(rows, LOG)


def stamps(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "at timestamp_ntz")


TIMES = [at(m) for m in range(-30, 800, 35)] + [at(10), at(10), at(10, 1), None]


def test_rows_and_counts_equal_the_question_for_each_time(spark):
    rows, times = log(spark), stamps(spark, *TIMES)
    got, want = {}, {}
    for r in timeline.claimable_at(rows, times).collect():
        got.setdefault(r["at"], []).append(r.id)
    for t in {t for t in TIMES if t is not None}:
        taken = jobs.claimable_jobs(rows, F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")).collect()
        want[t] = taken
    assert {t: sorted(v) for t, v in got.items()} == {
        t: sorted(r.id for r in v) for t, v in want.items() if v}
    counts = {r["at"]: (r.n_queued, r.n_stale) for r in timeline.claimable_counts(rows, times).collect()}
    assert counts == {t: (sum(r.status == "queued" for r in v), sum(r.status == "processing" for r in v))
                      for t, v in want.items()}


def test_states_hold_until_the_next_row_of_their_job(spark):
    rows, times = timeline.job_states(log(spark)), stamps(spark, *TIMES)
    got = sorted((r["at"], r.id) for r in timeline.claimable_at(rows, times).collect())
    want = []
    for t in {t for t in TIMES if t is not None}:
        now = F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
        held = rows.where((F.col("valid_from") <= now) & (
            F.col("valid_to").isNull() | (F.col("valid_to") > now)))
        want += [(t, r.id) for r in jobs.claimable_jobs(held, now).collect()]
    assert want and got == sorted(want)


def test_a_lock_is_stale_when_more_than_the_limit_has_passed(spark):
    rows = spark.createDataFrame(
        [("j", "d", "parse", "processing", at(0), None, at(0))], LOG)
    counts = timeline.claimable_counts(rows, stamps(spark, at(10), at(10, 1))).collect()
    assert sorted((r["at"], r.n_stale) for r in counts) == [(at(10), 0), (at(10, 1), 1)]


def test_nothing_to_ask_or_to_take(spark):
    rows = log(spark)
    assert timeline.claimable_counts(rows, stamps(spark).where("at is null")).count() == 0
    none = timeline.claimable_counts(rows.where("false"), stamps(spark, at(1))).collect()
    assert [(r.n_queued, r.n_stale) for r in none] == [(0, 0)]

import os
from dataclasses import replace

import pandas as pd
import pytest

from ledgerproof.config import DEFAULTS
from ledgerproof.plans import infer, resume

SCHEMA = "document_id string, raw string, tokens bigint"
QUICK = replace(DEFAULTS, backoff_base_seconds=0, max_attempts=3)


def requests(spark, n=40):
    return spark.createDataFrame(
        [(f"d{k}", f"text {k}") for k in range(n)], "document_id string, document_text string"
    )


def noted(log, ids):
    with open(log, "a") as out:
        out.write("".join(f"{d}\n" for d in ids))


def asked(log):
    return open(log).read().split() if os.path.exists(log) else []


def reply(batch):
    return batch[["document_id"]].assign(raw="ok " + batch.document_text, tokens=len(batch))


def test_a_run_that_died_is_resumed(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "answers")
    df = requests(spark)
    dies = sorted(r.bucket for r in resume.with_digest(df, 8).select("bucket").distinct().collect())[4]
    doomed = {r.document_id for r in resume.with_digest(df, 8).where(f"bucket = {dies}").collect()}

    def dying(batch):
        if doomed & set(batch.document_id):
            raise SystemExit("the machine went away")
        noted(log, batch.document_id)
        return reply(batch)

    with pytest.raises(Exception):
        resume.ask(df, dying, path, SCHEMA, buckets=8, settings=QUICK)
    before = asked(log)
    assert 0 < len(before) < 40 and len(set(before)) == len(before)

    def well(batch):
        noted(log, batch.document_id)
        return reply(batch)

    got = resume.ask(df, well, path, SCHEMA, buckets=8, settings=QUICK).collect()
    assert sorted(r.raw for r in got) == sorted(f"ok text {k}" for k in range(40))
    assert sorted(asked(log)) == sorted(f"d{k}" for k in range(40))  # each was asked once
    again = resume.ask(df, well, path, SCHEMA, buckets=8, settings=QUICK)
    assert again.count() == 40 and len(asked(log)) == 40


def test_failing_calls_are_retried_and_given_up(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "answers")
    df = requests(spark, 12)

    def flaky(batch):
        noted(log, batch.document_id)
        (d,) = batch.document_id
        if d == "d3":
            raise ValueError("never works")
        if d == "d5":
            return reply(batch).iloc[:0]
        if d == "d7" and asked(log).count("d7") < 2:
            raise ValueError("not yet")
        return reply(batch)

    got = resume.ask(df, flaky, path, SCHEMA, buckets=4, rows=1, settings=QUICK)
    assert {r.document_id for r in got.collect()} == {f"d{k}" for k in range(12)} - {"d3", "d5"}
    assert [asked(log).count(d) for d in ("d1", "d3", "d5", "d7")] == [1, 3, 3, 2]
    lost = {r.document_id: (r.attempts, r.error) for r in
            resume.unanswered(df, path, SCHEMA, 4, QUICK).collect()}
    assert lost == {"d3": (3, "never works"), "d5": (3, resume.NO_ANSWER)}


def test_delays_are_those_of_the_job_log(spark, tmp_path):
    waits = []

    def failing(batch):
        raise ValueError("no")

    def passed(seconds):  # as if the time had passed
        waits.append(seconds)
        raise StopIteration

    slow = replace(DEFAULTS, backoff_base_seconds=100)
    with pytest.raises(StopIteration):
        resume.ask(requests(spark, 1), failing, str(tmp_path / "a"), SCHEMA, settings=slow, wait=passed)
    assert 60 < waits[0] <= 100


def test_equal_requests_nulls_and_empty_tables(spark, tmp_path):
    log = str(tmp_path / "log")
    df = spark.createDataFrame(
        [("a", "x"), ("a", "x"), ("b", None)], "document_id string, document_text string"
    )

    def model(batch):
        noted(log, batch.document_id)
        return pd.DataFrame({"document_id": batch.document_id, "raw": None, "tokens": 1})

    got = resume.ask(df, model, str(tmp_path / "a"), SCHEMA, settings=QUICK).collect()
    assert sorted((r.document_id, r.raw, r.tokens) for r in got) == [("a", None, 1), ("b", None, 1)]
    assert sorted(asked(log)) == ["a", "b"]
    assert resume.ask(df.limit(0), model, str(tmp_path / "b"), SCHEMA, settings=QUICK).count() == 0


def test_call_model_with_a_folder(spark, tmp_path):
    def model(batch):
        return batch[["document_id"]].assign(
            raw="{}", review=None, input_tokens=1, output_tokens=2, latency_ms=3)

    for _ in range(2):
        got = infer.call_model(requests(spark, 5), model, "cheap", answers=str(tmp_path), settings=QUICK)
        assert sorted((r.document_id, r.latency_ms) for r in got.collect()) == [(f"d{k}", 3) for k in range(5)]

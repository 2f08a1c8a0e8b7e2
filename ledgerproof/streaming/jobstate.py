"""The state of every job, kept by a stream of job events.

Events are `document_id, stage, event_id, at, kind, logged_at` with kind `locked`, `failed`,
`rejected` or `done`; `logged_at` is when the row was added to the log. State is kept per (document_id, stage) in the state store: the first failures up to the limit
of attempts, the first rejection, and the last lock and finish. All of these are minima and maxima
over the events, so any order of events and any division into batches leads to the same state, which
is that of `fold_failures`. The stream's clock is the log's own: a timer is set for when a lock goes
stale, and if the job is still locked when the log has come that far, it is queued again and says so.

Every change gives a row with the whole state and a version; the highest version counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from ledgerproof.config import DEFAULTS, Settings
from ledgerproof.streaming.flows import stage_stream

EVENTS = (
    "document_id string, stage string, event_id bigint, at timestamp, kind string, "
    "logged_at timestamp"
)
STATE = (
    "failures array<struct<at:bigint,id:bigint>>, rejected struct<at:bigint,id:bigint>, "
    "locked struct<at:bigint,id:bigint>, finished struct<at:bigint,id:bigint>, reclaimed bigint, "
    "version bigint"
)
JOB_STATE = (
    "document_id string, stage string, attempts int, job_status string, document_status string, "
    "next_run_at timestamp, locked_at timestamp, reclaimed boolean, version bigint"
)
#: The state needs column families, which this store has.
STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
SECOND = 1_000_000


class JobProcessor(StatefulProcessor):
    """Folds the events of one job into its state. Times are microseconds."""

    def __init__(self, settings: Settings, timers: bool):
        self.settings = settings
        self.timers = timers
        self.stale = settings.stale_lock_minutes * 60 * SECOND

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        failures, rejected, locked, finished, reclaimed, version = self.held()
        before = locked
        for frame in rows:
            at = frame["at"].astype("datetime64[us]").astype("int64")
            for moment, number, kind in zip(at.tolist(), frame["event_id"].tolist(), frame["kind"]):
                event = (moment, number)
                if kind == "failed":
                    if event not in failures:  # an event that comes twice counts once
                        failures = sorted([*failures, event])[: self.settings.max_attempts]
                elif kind == "rejected":
                    rejected = min(filter(None, (rejected, event)))
                elif kind == "locked":
                    locked = max(filter(None, (locked, event)))
                elif kind == "done":
                    finished = max(filter(None, (finished, event)))
        if locked != before and self.timers:
            self.handle.registerTimer((locked[0] + self.stale) // 1000 + 1)
        yield self.saved(key, failures, rejected, locked, finished, reclaimed, version + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, rejected, locked, finished, reclaimed, version = self.held()
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if locked and locked[0] + self.stale <= due and reclaimed != locked[0]:
            if self.judged(failures, rejected, locked, finished, reclaimed)["job_status"] == "processing":
                yield self.saved(key, failures, rejected, locked, finished, locked[0], version + 1)

    def held(self):
        if not self.state.exists():
            return [], None, None, None, None, 0
        failures, *marks, reclaimed, version = self.state.get()
        pairs = [tuple(x) if x is not None else None for x in marks]
        return [tuple(x) for x in failures], *pairs, reclaimed, version

    def saved(self, key, failures, rejected, locked, finished, reclaimed, version) -> pd.DataFrame:
        self.state.update((failures, rejected, locked, finished, reclaimed, version))
        row = self.judged(failures, rejected, locked, finished, reclaimed)
        frame = pd.DataFrame([{"document_id": key[0], "stage": key[1], **row, "version": version}])
        for name in ("next_run_at", "locked_at"):
            frame[name] = pd.to_datetime(frame[name], unit="us", utc=True)
        frame["attempts"] = frame["attempts"].astype("int32")
        return frame[[c.split(" ")[0] for c in JOB_STATE.split(", ")]]

    def judged(self, failures, rejected, locked, finished, reclaimed) -> dict:
        """What the job is by its events; see `fold_failures` for failures and rejections."""
        counted = [f for f in failures if rejected is None or f < rejected]
        dead = len(counted) >= self.settings.max_attempts
        out = {
            "attempts": len(counted), "job_status": "queued", "document_status": None,
            "next_run_at": None, "locked_at": None, "reclaimed": False,
        }
        if dead or rejected:
            return out | {
                "job_status": "failed", "document_status": "failed" if dead else "rejected",
            }
        last = max(counted, default=(0, 0))
        if finished and finished > last and finished > (locked or (0, 0)):
            return out | {"job_status": "done"}
        if locked and locked > last and locked > (finished or (0, 0)):
            if reclaimed == locked[0]:
                return out | {"next_run_at": locked[0] + self.stale, "reclaimed": True}
            return out | {"job_status": "processing", "locked_at": locked[0]}
        if counted:
            wait = self.settings.backoff_base_seconds * 2 ** (len(counted) - 1)
            out["next_run_at"] = last[0] + wait * SECOND
        return out


def job_states(
    events: DataFrame, settings: Settings = DEFAULTS, out_of_order: str = "1 minute"
) -> DataFrame:
    """A row of JOB_STATE for every change of a job; of a batch of all events, one row per job.

    Rows of the log may come `out_of_order` by so much; `at` may have any order. The session needs the
    state store of `STORE`.
    """
    live = events.isStreaming
    events.sparkSession.streams  # noqa: B018 - starts what coordinates state, for batches as well
    return events.withWatermark("logged_at", out_of_order).groupBy(
        "document_id", "stage"
    ).transformWithStateInPandas(
        JobProcessor(settings, live), outputStructType=JOB_STATE, outputMode="Update",
        timeMode="EventTime" if live else "None",
    )


def job_state_stream(
    events: DataFrame, path: str, checkpoint: str, available_now: bool = True,
    settings: Settings = DEFAULTS, out_of_order: str = "1 minute",
) -> StreamingQuery:
    """Keep the job states of a stream of events in the table at `path`."""
    changes = job_states(events, settings, out_of_order)
    return stage_stream(changes, lambda rows: rows, path, checkpoint, available_now)


def current_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The last state of every job in the table that `job_state_stream` keeps."""
    rows = spark.read.schema(JOB_STATE).parquet(path)
    names = [c for c in rows.columns if c not in ("document_id", "stage")]
    return rows.groupBy("document_id", "stage").agg(
        F.max_by(F.struct(*names), "version").alias("last")
    ).select("document_id", "stage", "last.*")

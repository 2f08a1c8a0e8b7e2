"""Job log queries; an event is a job row of the document `u<user_id>`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerproof.catalog.core import query
from ledgerproof.config import JOB_STAGES
from ledgerproof.operators import jobs as j
from ledgerproof.operators.review import latest_jobs

NOW = "2024-01-15 12:00:00"


def jobs(t):
    n = F.col("event_id")
    stages = F.array(*[F.lit(s) for s in JOB_STAGES])
    status = F.create_map(*[F.lit(x) for x in (
        "view", "queued", "purchase", "queued", "click", "processing", "signup", "done",
        "error", "failed")])
    return t.events.select(
        F.concat(F.lit("J"), F.lpad(n.cast("string"), 12, "0")).alias("id"),
        F.concat(F.lit("u"), "user_id").alias("document_id"),
        F.element_at(stages, (n % 4 + 1).cast("int")).alias("stage"),
        F.try_element_at(status, F.col("event_type")).alias("status"),
        (n % 6).cast("int").alias("attempts"),
        F.when(F.col("event_type") == "click", F.col("ts")).alias("locked_at"),
        (F.col("ts") + F.make_interval(days=(n % 3).cast("int"))).alias("next_run_at"),
        F.when(F.col("event_type") == "error", "boom").alias("last_error"),
        F.col("ts").alias("created_at"),
        n.alias("event_id"),
    )


JOBS_SQL = """
jobs AS (
  SELECT 'J' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, 'u' || user_id AS document_id,
    ['parse', 'classify', 'extract', 'validate'][event_id % 4 + 1] AS stage,
    CASE event_type WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'queued' WHEN 'click' THEN 'processing'
      WHEN 'signup' THEN 'done' WHEN 'error' THEN 'failed' END AS status,
    CAST(event_id % 6 AS INTEGER) AS attempts,
    CASE WHEN event_type = 'click' THEN ts END AS locked_at,
    ts + to_days(CAST(event_id % 3 AS INTEGER)) AS next_run_at, ts AS created_at, event_id
  FROM events)
"""
STAMP = "%Y-%m-%d %H:%M:%S.%f"


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query("claimable_jobs", "WITH " + JOBS_SQL + f"""
SELECT id, document_id, stage, status, strftime(created_at, '{STAMP}') AS created_at FROM jobs
WHERE (status = 'queued' AND next_run_at <= TIMESTAMP '{NOW}')
   OR (status = 'processing' AND locked_at < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE)
ORDER BY created_at, id""")
def claimable_jobs(t):
    now = F.lit(NOW).cast("timestamp_ntz")
    return j.claimable_jobs(jobs(t), now).select(
        "id", "document_id", "stage", "status", _stamp("created_at").alias("created_at")
    )


@query("backoff_schedule", "WITH " + JOBS_SQL + f"""
SELECT id, CAST(10 * pow(2, greatest(attempts - 1, 0)) AS BIGINT) AS delay_seconds,
  strftime(created_at + to_seconds(CAST(10 * pow(2, greatest(attempts - 1, 0)) AS BIGINT)), '{STAMP}') AS next_run_at
FROM jobs""")
def backoff_schedule(t):
    return jobs(t).select(
        "id", j.backoff_seconds(F.col("attempts")).alias("delay_seconds"),
        _stamp(j.next_run_at(F.col("created_at"), F.col("attempts"))).alias("next_run_at"),
    )


def _folded(t):
    failures = jobs(t).where(F.col("status") == "failed").select(
        "document_id", "stage", F.col("created_at").alias("failed_at"), "event_id",
        (F.col("event_id") % 97 == 0).alias("rejected"),
    )
    return j.fold_failures(failures)


FOLD_SQL = "WITH " + JOBS_SQL + f""",
failures AS (SELECT document_id, stage, created_at, event_id, event_id % 97 = 0 AS rejected
  FROM jobs WHERE status = 'failed'),
lived AS (
  -- In order of time: how often a job had failed when this row was written, and whether it had
  -- been rejected by then.
  SELECT *, sum(CASE WHEN rejected THEN 0 ELSE 1 END) OVER w AS failed_so_far,
    max(CASE WHEN rejected THEN 1 ELSE 0 END) OVER w AS rejected_by_now
  FROM failures
  WINDOW w AS (PARTITION BY document_id, stage ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING)),
counted AS (
  SELECT document_id, stage,
    count(*) FILTER (NOT rejected AND rejected_by_now = 0 AND failed_so_far <= 5) AS attempts,
    max(created_at) FILTER (NOT rejected AND rejected_by_now = 0 AND failed_so_far <= 5) AS at_,
    max(rejected_by_now) AS rejected
  FROM lived GROUP BY document_id, stage),
folded AS (
  SELECT document_id, stage, CAST(attempts AS INTEGER) AS attempts,
    CASE WHEN attempts >= 5 OR rejected = 1 THEN 'failed' ELSE 'queued' END AS job_status,
    CASE WHEN attempts >= 5 THEN 'failed' WHEN rejected = 1 THEN 'rejected' END AS document_status,
    CASE WHEN attempts < 5 AND rejected = 0 THEN
      strftime(at_ + to_seconds(CAST(10 * pow(2, greatest(attempts - 1, 0)) AS BIGINT)), '{STAMP}') END AS next_run_at
  FROM counted)
"""


@query("retry_fold", FOLD_SQL + "SELECT * FROM folded")
def retry_fold(t):
    return _folded(t).withColumn("next_run_at", _stamp("next_run_at"))


@query("dead_letter", FOLD_SQL + """
SELECT document_id, stage, attempts, document_status FROM folded WHERE job_status = 'failed'""")
def dead_letter(t):
    return j.dead_letters(_folded(t)).select("document_id", "stage", "attempts", "document_status")


@query("follow_up_jobs", "WITH " + JOBS_SQL + """
SELECT id, CASE stage WHEN 'parse' THEN 'classify' WHEN 'classify' THEN 'extract' ELSE 'validate' END AS stage,
  'queued' AS status FROM jobs WHERE status = 'done' AND stage <> 'validate'""")
def follow_up_jobs(t):
    done = jobs(t).where(F.col("status") == "done")
    return j.follow_up_jobs(done).select("id", "stage", "status")


@query("stage_progress", "WITH " + JOBS_SQL + """,
s AS (
  SELECT document_id, min(CASE WHEN stage = 'parse' THEN created_at END) AS a,
    min(CASE WHEN stage = 'classify' THEN created_at END) AS b,
    min(CASE WHEN stage = 'extract' THEN created_at END) AS c,
    min(CASE WHEN stage = 'validate' THEN created_at END) AS d,
    sum(CASE WHEN status = 'done' THEN 1 ELSE 0 END) AS n_done
  FROM jobs GROUP BY document_id)
SELECT document_id, CASE WHEN d IS NOT NULL THEN 'validate' WHEN c IS NOT NULL THEN 'extract'
    WHEN b IS NOT NULL THEN 'classify' ELSE 'parse' END AS reached, n_done,
  date_sub('second', a, b) AS parse_seconds, date_sub('second', b, c) AS classify_seconds,
  date_sub('second', c, d) AS extract_seconds FROM s""")
def stage_progress(t):
    return j.stage_progress(jobs(t))


@query("orphan_jobs", "WITH " + JOBS_SQL + """
SELECT id, document_id, 'failed' AS status, 'document not found' AS last_error FROM jobs
WHERE document_id NOT IN (SELECT 'u' || doc_id FROM labels)""")
def orphan_jobs(t):
    documents = t.labels.select(F.concat(F.lit("u"), "doc_id").alias("id"))
    return j.orphan_jobs(jobs(t), documents).select("id", "document_id", "status", "last_error")


@query("latest_job", "WITH " + JOBS_SQL + """
SELECT document_id, max_by(id, strftime(created_at, '%Y%m%d%H%M%S%f') || id) AS job_id,
  max_by(stage, strftime(created_at, '%Y%m%d%H%M%S%f') || id) AS stage,
  max_by(status, strftime(created_at, '%Y%m%d%H%M%S%f') || id) AS status,
  max_by(attempts, strftime(created_at, '%Y%m%d%H%M%S%f') || id) AS attempts
FROM jobs GROUP BY document_id""")
def latest_job(t):
    return latest_jobs(jobs(t)).select("document_id", "job_id", "stage", "status", "attempts")

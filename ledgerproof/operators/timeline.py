"""The job log at many times at once.

Each job has a span of time in which a worker may take it. Times and the ends of spans are put in one
order, hour by hour, and each end becomes the number of times before it; so a span is a run of times,
found without comparing spans with times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerproof.config import DEFAULTS, Settings

FOREVER = "9999-12-31 00:00:00"
WIDTH = 4096


def job_states(log: DataFrame) -> DataFrame:
    """Rows of a job log with `valid_from, valid_to`: a row holds until the next of its
    (document_id, stage), by `created_at` and `id`; the last holds on (null)."""
    order = Window.partitionBy("document_id", "stage").orderBy("created_at", "id")
    return log.withColumn("valid_from", F.col("created_at")).withColumn(
        "valid_to", F.lead("created_at").over(order)
    )


def claimable_spans(jobs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The jobs that may be taken at some time, with `from_at` and `until_at` (exclusive): queued ones
    from when they are due, processing ones from when their lock is stale. Where the jobs have
    `valid_from, valid_to`, only while they are valid."""
    # A lock is stale when more than the limit has passed; times are whole microseconds.
    stale = F.col("locked_at") + F.make_interval(
        mins=F.lit(settings.stale_lock_minutes), secs=F.lit("0.000001").cast("decimal(18,6)")
    )
    start = F.when(F.col("status") == "queued", F.col("next_run_at")).when(
        F.col("status") == "processing", stale
    )
    forever = F.lit(FOREVER).cast(jobs.schema["created_at"].dataType)
    end = forever
    known = start.isNotNull()
    if "valid_to" in jobs.columns:
        start, end = F.greatest(start, "valid_from"), F.coalesce("valid_to", forever)
    return jobs.where(known).withColumns({"from_at": start, "until_at": end}).where(
        F.col("from_at") < F.col("until_at")
    )


def _hour(at: Column, kind) -> Column:
    return F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast(kind), at) / 3600)


def times_before(times: DataFrame, points: DataFrame) -> DataFrame:
    """`at, n_before` for every distinct `at` of both: how many distinct times are before it.

    Instants are ordered within their hour, and hours by one row each.
    """
    kind = points.schema["at"].dataType
    marked = times.select(F.col("at").cast(kind).alias("at"), F.lit(1).alias("is_time")).unionByName(
        points.select("at", F.lit(0).alias("is_time"))
    ).where("at is not null")
    instants = marked.groupBy("at").agg(F.max("is_time").alias("is_time")).withColumn(
        "hour", _hour(F.col("at"), kind)
    )
    hours = instants.groupBy("hour").agg(F.sum("is_time").alias("n"))
    earlier = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("hour").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = hours.select("hour", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return instants.withColumn("local", F.coalesce(F.sum("is_time").over(within), F.lit(0))).join(
        starts, "hour"
    ).select("at", (F.col("start") + F.col("local")).alias("n_before"), "is_time")


def _placed(spans: DataFrame, places: DataFrame) -> DataFrame:
    """Spans with the run of times in them: `first` to before `behind`."""
    return (
        spans.join(places.select(F.col("at").alias("from_at"), F.col("n_before").alias("first")), "from_at")
        .join(places.select(F.col("at").alias("until_at"), F.col("n_before").alias("behind")), "until_at")
        .where(F.col("first") < F.col("behind"))
    )


def _places(spans: DataFrame, times: DataFrame) -> DataFrame:
    ends = spans.select(F.explode(F.array("from_at", "until_at")).alias("at"))
    return times_before(times, ends)


def claimable_at(jobs: DataFrame, times: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The jobs that may be taken `at` each of the times: a row per job and time, as many as
    `claimable_jobs` gives for all times together."""
    spans = claimable_spans(jobs, settings)
    places = _places(spans, times)
    runs = _placed(spans, places).withColumn(
        "n_before", F.explode(F.sequence(F.col("first"), F.col("behind") - 1))
    )
    return runs.join(places.where("is_time = 1").select("at", "n_before"), "n_before").drop(
        "n_before", "first", "behind", "from_at", "until_at"
    )


def claimable_counts(jobs: DataFrame, times: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """`at, n_queued, n_stale`: how many jobs may be taken at each distinct time, also 0.

    A span adds one at its first time and takes it away behind its last; these are summed per time
    before they meet, then along blocks of times, so nothing grows with the product of both.
    """
    spans = claimable_spans(jobs, settings).select(
        "from_at", "until_at", (F.col("status") == "queued").cast("long").alias("q"),
        (F.col("status") == "processing").cast("long").alias("s"),
    ).groupBy("from_at", "until_at").agg(F.sum("q").alias("q"), F.sum("s").alias("s"))
    places = _places(spans, times)
    steps = _placed(spans, places).select(F.inline(F.array(
        F.struct(F.col("first").alias("n_before"), "q", "s"),
        F.struct(F.col("behind").alias("n_before"), (-F.col("q")).alias("q"), (-F.col("s")).alias("s")),
    ))).groupBy("n_before").agg(F.sum("q").alias("q"), F.sum("s").alias("s"))
    each = places.where("is_time = 1").select("at", "n_before").join(steps, "n_before", "left").select(
        "at", "n_before", F.coalesce("q", F.lit(0)).alias("q"), F.coalesce("s", F.lit(0)).alias("s"),
        F.floor(F.col("n_before") / WIDTH).alias("block"),
    )
    upto = Window.partitionBy("block").orderBy("n_before")
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = each.groupBy("block").agg(F.sum("q").alias("bq"), F.sum("s").alias("bs")).select(
        "block", F.coalesce(F.sum("bq").over(earlier), F.lit(0)).alias("q0"),
        F.coalesce(F.sum("bs").over(earlier), F.lit(0)).alias("s0"),
    )
    return each.withColumns({"q": F.sum("q").over(upto), "s": F.sum("s").over(upto)}).join(
        blocks, "block"
    ).select("at", (F.col("q0") + F.col("q")).alias("n_queued"), (F.col("s0") + F.col("s")).alias("n_stale"))

"""Session settings the operators are written for, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more shuffle later.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM does not compile methods beyond 8000 bytes; past that size separate
    # projections, which are split into small methods, are faster than one stage.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Recording a Python call site per expression dominates plan building here.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the recommended settings to a session builder."""
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def with_small_methods(spark: SparkSession) -> SparkSession:
    """Give a session that has Spark's own limit on the size of generated methods the recommended one.

    The steps of a record are long: beyond the limit the JVM runs them uncompiled, which takes about
    twice the CPU time. A session with a limit of its own keeps it.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":
        spark.conf.set(key, RECOMMENDED[key])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by `spark.checkpoint.dir`.

    The setting is required: a machine-local path would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return folder


def with_local_folder(spark: SparkSession) -> SparkSession:
    """Name a work folder for a session on one machine that has none, as tests and tools use.

    A cluster's session is left as it is.
    """
    unset = not spark.conf.get("spark.checkpoint.dir", None)
    if unset and spark.sparkContext.master.partition("[")[0] == "local":
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ledgerproof-"))
    return spark


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """Shuffle files of what is built and run inside are removed as soon as it has run.

    For what is written and then read back, as in loops whose rounds are each written: otherwise the
    files stay on the executors' disks until the driver collects garbage.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and return the written table.

    Used behind anything that must not be evaluated twice (a model call): the
    files survive the loss of an executor, a cached copy does not. What was
    shuffled to make them is not kept on the executors' disks beside them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with dropping_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

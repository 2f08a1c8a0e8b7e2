"""Windows that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def run_index(
    df: DataFrame, group: str, order: list[str], value: str, out: str, width: int = 4096
) -> DataFrame:
    """Number the runs of equal consecutive `value` per `group`, from 0.

    Rows are windowed per (group, block of `width` order numbers), so a very
    long group is many tasks. Each block is then reduced to one row, and only
    these are ordered per group to find the number the block starts from.
    """
    block = F.floor(F.col(order[0]) / width)
    df = df.withColumn("_block", block)
    local = Window.partitionBy(group, "_block").orderBy(*order)
    first = F.row_number().over(local) == 1
    change = F.when(first, 0).otherwise(
        (~F.lag(value).over(local).eqNullSafe(F.col(value))).cast("int")
    )
    df = df.withColumn("_change", change)
    df = df.withColumn("_local", F.sum("_change").over(local))
    at = F.struct(*order)
    blocks = df.groupBy(group, "_block").agg(
        F.min_by(value, at).alias("_first"),
        F.max_by(value, at).alias("_last"),
        F.sum("_change").alias("_changes"),
    )
    across = Window.partitionBy(group).orderBy("_block")
    before = F.lag(F.struct(F.col("_last").alias("v"))).over(across)
    step = F.when(before.isNull(), F.lit(0)).otherwise(
        (~before["v"].eqNullSafe(F.col("_first"))).cast("int")
    )
    blocks = blocks.withColumn("_step", step)
    blocks = blocks.select(
        group, "_block",
        (
            F.sum(F.col("_step") + F.col("_changes")).over(across) - F.col("_changes")
        ).alias("_start"),
    )
    return (
        df.join(blocks, [group, "_block"])
        .withColumn(out, (F.col("_start") + F.col("_local")).cast("int"))
        .drop("_block", "_change", "_local", "_start")
    )

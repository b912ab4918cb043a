"""Gapless positions of rows in an order, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize


def partitions_of(spark: SparkSession) -> int:
    """Partitions for a shuffle that is dealt by hand: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_positions(df: DataFrame, order: list[Column], kind: str, group: str | None = None,
                   position: str = "position") -> DataFrame:
    """``df``, written once in ``order``, plus a gapless position from 0.

    With ``group`` (which must be the first column of ``order``) the positions
    start again in each value of it.  Rows are dealt by range, every row knows
    its place in its own task, and a table with one row per (task, group) met
    gives the offsets; no window spans a whole group, so a group that holds a
    third of all rows is spread over a third of the tasks.
    """
    spark = df.sparkSession
    keys = ["_pid"] + ([group] if group else [])
    written = materialize(
        df.repartitionByRange(partitions_of(spark), *order).sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id()), kind)
    runs = written.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = (Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy("_pid")
              .rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*keys, "_first",
                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = written.alias("w").join(
        runs.alias("r"), [F.col(f"w.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return joined.select(*[f"w.{c}" for c in df.columns],
                         (F.col("r._before") + F.col("w._mid") - F.col("r._first")).alias(position))

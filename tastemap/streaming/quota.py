"""Fixed-window quota audit (T1), in batch and in Structured Streaming.

Calls per (client, endpoint, window) are counted and the counts above the
quota are flagged.  Windows are aligned to the clock (session time zone UTC).

The stream runs in ``update`` mode behind a watermark, so state of closed
windows is dropped and events later than the watermark are not counted.
Each micro-batch writes its updated counts to its own ``batch_id=`` folder
(overwrite: a replayed batch rewrites the same folder, exactly once); counts
only grow within a window, so the answer is the largest count per key over
all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import QUOTAS
from ..operators.broadcast import sized_broadcast

KEYS = ["client", "endpoint", "window_start", "window_end"]


def _with_quota(counts: DataFrame, quota) -> DataFrame:
    """``quota`` is a number, or an ``(endpoint, quota)`` table (one row per
    endpoint, broadcast behind a size check)."""
    if isinstance(quota, DataFrame):
        table = sized_broadcast(quota.select("endpoint", "quota"), row_bytes=64)
        return counts.join(table, "endpoint")
    return counts.withColumn("quota", F.lit(int(quota)).cast("long"))


def route_quotas(spark: SparkSession) -> DataFrame:
    """The service's own quota table: ``(endpoint, quota)`` per route (``fixed.QUOTAS``)."""
    return spark.createDataFrame(list(QUOTAS), "endpoint string, quota long")


def window_counts(log: DataFrame, window: str) -> DataFrame:
    """Calls per client, endpoint and fixed window (partial counts map-side)."""
    return (log.groupBy("client", "endpoint", F.window("ts", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("calls"))
            .select("client", "endpoint", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "calls"))


def over_quota(log: DataFrame, window: str, quota) -> DataFrame:
    """Batch audit: ``(client, endpoint, window_start, window_end, calls, quota)`` over the quota."""
    return _with_quota(window_counts(log, window), quota).where(F.col("calls") > F.col("quota"))


def audit(log: DataFrame, window: str, quota) -> DataFrame:
    """Every window's calls beside its quota, ``over_quota`` where there are too many."""
    return (_with_quota(window_counts(log, window), quota)
            .withColumn("over_quota", F.col("calls") > F.col("quota")))


def run_stream(spark: SparkSession, source: DataFrame, out_path: str, checkpoint: str,
               window: str, watermark: str = "1 hour", available_now: bool = True):
    """Run the streaming count from a streaming ``source`` of ``(ts, client, endpoint)``.

    Returns the finished (or running) ``StreamingQuery``.
    """
    counts = (source.withWatermark("ts", watermark)
              .groupBy("client", "endpoint", F.window("ts", window).alias("w"))
              .agg(F.count(F.lit(1)).alias("calls"))
              .select("client", "endpoint", F.col("w.start").alias("window_start"),
                      F.col("w.end").alias("window_end"), "calls"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = (counts.writeStream.outputMode("update")
              .option("checkpointLocation", checkpoint)
              .foreachBatch(write_batch))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def uncounted(log: DataFrame, out_path: str, window: str) -> DataFrame:
    """What the stream left out: ``(client, endpoint, window_start, window_end, calls, late)`` of the
    windows in which the log has more calls than the stream counted (events behind the watermark)."""
    counted = (log.sparkSession.read.parquet(out_path).groupBy(*KEYS).agg(F.max("calls").alias("counted")))
    late = F.col("calls") - F.coalesce("counted", F.lit(0))
    return (window_counts(log, window).join(counted, KEYS, "left").withColumn("late", late)
            .where(F.col("late") > 0).drop("counted"))


def read_stream_result(spark: SparkSession, out_path: str, quota) -> DataFrame:
    """Compact the per-batch changelog: last (largest) count per key, over the quota."""
    changes = spark.read.parquet(out_path)
    latest = changes.groupBy(*KEYS).agg(F.max("calls").alias("calls"))
    return _with_quota(latest, quota).where(F.col("calls") > F.col("quota"))

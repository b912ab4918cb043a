"""First breach alarms of the quota (T1) as a stream, and the calls that come too late for it.

State is keyed by client and endpoint: the key's latest call, and the number of
calls of each window that is not closed.  The call that takes a window's number
above its quota raises one alarm, with that call's time, in the micro-batch that
brings it.  A key has a clock of its own, its latest call of earlier
micro-batches: a window is closed when it ended ``delay`` before that.  A call of
a closed window is not dropped but given out as late, so the calls of a window
are those counted and those late, whatever the order of arrival, and a slow
client isn't closed by a fast one.  The state of a key that stays silent goes by
the time of arrival.

The state is two tables below the checkpoint, which a micro-batch reads, joins
and writes anew: joins and grouped aggregates over all keys, no call per key.
They are written in turn to two folders, so a replayed batch finds what the
batch before it left.

Each micro-batch writes its rows to its own ``batch_id=`` folder (overwrite: a
replayed batch rewrites the same folder).  Kinds of rows: ``count`` (calls of
the window so far), ``alarm`` (the first call above the quota) and ``late``;
``at`` is the time of the alarm's call, else of the last one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.broadcast import shuffled
from ..session import materialize
from .quota import KEYS, _with_quota

KEY = ["client", "endpoint"]


def _same(left: DataFrame, right: DataFrame, columns: list[str], carry: list[str]) -> DataFrame:
    """``left`` with the columns ``carry`` of ``right``, of one row per key; nulls are equal."""
    named = right.select(*[F.col(c).alias(f"_{c}") for c in columns], *carry)
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    return left.join(shuffled(named), on, "left").drop(*[f"_{c}" for c in columns])


def _closed(delay_us: int):
    return F.unix_micros("window_end") <= F.unix_micros("latest") - delay_us


def _windows(calls: DataFrame, keys: DataFrame, opened: DataFrame, delay_us: int) -> DataFrame:
    """A row for each window of a micro-batch's calls: how many, before and now, whether they are late,
    the time of the last and of the first above the quota."""
    window = ["client", "endpoint", "window_end"]
    placed = _same(calls, keys, KEY, ["latest"])
    placed = _same(placed, opened.select(*window, F.col("calls").alias("before")), window, ["before"])
    nth = F.row_number().over(Window.partitionBy(*window).orderBy("ts"))
    late, before = F.coalesce(_closed(delay_us), F.lit(False)), F.coalesce("before", F.lit(0).cast("long"))
    placed = placed.select(*KEYS, "ts", "quota", "arrived", late.alias("is_late"), before.alias("before"), nth.alias("nth"))
    return placed.groupBy(*KEYS, "is_late", "before", "quota").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("at"), F.max("arrived").alias("arrived"),
        F.max(F.when(F.col("nth") == F.col("quota") - F.col("before") + 1, F.col("ts"))).alias("breach"))


def _rows(windows: DataFrame) -> DataFrame:
    """The rows of kind ``count`` or ``late``, and ``alarm``."""
    def row(kind, calls, at):
        return F.struct(kind.alias("kind"), calls.cast("long").alias("calls"), at.alias("at"))

    now = F.col("before") + F.col("n")
    seen = F.when(F.col("is_late"), row(F.lit("late"), F.col("n"), F.col("at"))).otherwise(
        row(F.lit("count"), now, F.col("at")))
    breach = ~F.col("is_late") & (F.col("before") <= F.col("quota")) & (now > F.col("quota"))
    alarm = F.when(breach, row(F.lit("alarm"), F.col("quota") + 1, F.col("breach")))
    return (windows.select(*KEYS, "quota", F.explode(F.array_compact(F.array(seen, alarm))).alias("r"))
            .select(*KEYS, "r.kind", "r.calls", "quota", "r.at"))


def run_alarms(spark: SparkSession, source: DataFrame, out_path: str, checkpoint: str, window: str, quota,
               delay: str = "1 hour", silent: str = "7 days", available_now: bool = True):
    """Run the alarms from a streaming ``source`` of ``(ts, client, endpoint)``; returns the query.

    ``quota`` is a number or an ``(endpoint, quota)`` table.  A call after
    ``silent`` (time of arrival) finds no state: its window starts anew, so
    ``silent`` should be far above the window and the delay.
    """
    width = F.window("ts", window)
    placed = _with_quota(
        source.select("ts", "client", "endpoint", width.alias("w"), F.current_timestamp().alias("arrived"))
        .select("ts", "client", "endpoint", F.col("w.start").alias("window_start"),
                F.col("w.end").alias("window_end"), "arrived"), quota)
    client, endpoint = (placed.schema[c].dataType.simpleString() for c in KEY)
    keys_type = f"client {client}, endpoint {endpoint}, latest timestamp, arrived timestamp"
    open_type = f"client {client}, endpoint {endpoint}, window_end timestamp, calls long"
    delay_us, silent_us = (int(pd.Timedelta(x).total_seconds() * 10 ** 6) for x in (delay, silent))

    def state(batch_id: int, name: str) -> str:
        return f"{checkpoint}/alarm_state/{batch_id % 2}/{name}"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        if batch_id:
            keys, opened = (own.read.schema(t).parquet(state(batch_id - 1, n))
                            for t, n in ((keys_type, "keys"), (open_type, "open")))
        else:
            keys, opened = own.createDataFrame([], keys_type), own.createDataFrame([], open_type)
        # Another call finds no state once its key was silent for too long.
        heard = F.unix_micros("arrived") + silent_us >= F.unix_micros(F.current_timestamp())
        keys = keys.where(heard)
        opened = _same(opened, keys, KEY, ["latest"]).where(F.col("latest").isNotNull()).drop("latest")
        windows = materialize(_windows(batch, keys, opened, delay_us), "alarm_windows")
        _rows(windows).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        fresh = windows.select(*KEY, F.col("at").alias("latest"), "arrived")
        now = keys.unionByName(fresh).groupBy(*KEY).agg(F.max("latest").alias("latest"), F.max("arrived").alias("arrived"))
        now.write.mode("overwrite").parquet(state(batch_id, "keys"))
        now = own.read.schema(keys_type).parquet(state(batch_id, "keys"))
        counted = windows.where(~F.col("is_late")).select(*KEY, "window_end", (F.col("before") + F.col("n")).alias("calls"))
        counts = opened.unionByName(counted).groupBy(*KEY, "window_end").agg(F.max("calls").alias("calls"))
        (_same(counts, now, KEY, ["latest"]).where(~_closed(delay_us)).drop("latest")
         .write.mode("overwrite").parquet(state(batch_id, "open")))

    writer = placed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write_batch)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def read_alarms(spark: SparkSession, out_path: str) -> DataFrame:
    """``(client, endpoint, window_start, window_end, quota, counted, late, alarms, breached_at)`` of every window."""
    rows = spark.read.parquet(out_path)

    def of(kind: str, column: str):
        return F.when(F.col("kind") == kind, F.col(column))

    return rows.groupBy(*KEYS).agg(
        F.max("quota").alias("quota"), F.coalesce(F.max(of("count", "calls")), F.lit(0)).alias("counted"),
        F.coalesce(F.sum(of("late", "calls")), F.lit(0)).alias("late"), F.count(of("alarm", "calls")).alias("alarms"),
        F.min(of("alarm", "at")).alias("breached_at"))

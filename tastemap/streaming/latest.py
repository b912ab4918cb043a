"""Last write wins as a stream (A7 over S3): landed list pages in any order.

A list is written in order, so an entry's write order is its page and its
place there.  State is a streaming aggregate: for each pair the order, the
rating and the arrival of the last write seen.  A later write changes it and
is passed on, an earlier one that arrives late is not.  A state belongs to a
window of ``expire`` on the time of arrival and goes when that is over; what
it would have held back is passed on then, and the reader's ``max_by`` over the
written changes decides, so expiry costs output, never correctness.  State is
in RocksDB, so the pairs needn't fit the executors' memory.

Each micro-batch writes its changes to its own ``batch_id=`` folder
(overwrite: a replayed batch rewrites the same folder).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

#: Entries that a page may hold at most (a landed page has up to 1000).
PAGE_PLACES = 1 << 20

_OUT = "user_key string, item_id long, rating int, written long"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def entries(pages: DataFrame) -> DataFrame:
    """``(user_key, item_id, rating, written)`` of the rated entries of landed pages."""
    each = pages.select("user_key", "page", F.posexplode("data").alias("at", "e"))
    return (each.select("user_key", F.col("e.node.id").cast("long").alias("item_id"),
                        F.coalesce(F.col("e.list_status.score"), F.lit(0)).cast("int").alias("rating"),
                        (F.col("page").cast("long") * PAGE_PLACES + F.col("at")).alias("written"))
            .where(F.col("rating") > 0))


def _changes(placed: DataFrame, expire_ms: int) -> DataFrame:
    """The pairs whose last write seen came in this micro-batch."""
    seen = placed.groupBy("user_key", "item_id", F.window("arrived", f"{expire_ms} milliseconds")).agg(
        F.max_by("rating", "written").alias("rating"), F.max_by("arrived", "written").alias("since"),
        F.max("written").alias("written"), F.max("arrived").alias("arrived"))
    return seen.where("since = arrived").select("user_key", "item_id", "rating", "written")


def run_latest(spark: SparkSession, landing: str, out_path: str, checkpoint: str, expire: str = "7 days",
               available_now: bool = True, files_per_trigger: int | None = None):
    """Start (and with ``available_now`` finish) the stream over landed pages; returns the query."""
    reader = spark.readStream.schema(schemas.LIST_PAGE).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    expire_ms = int(pd.Timedelta(expire).total_seconds() * 1000)
    placed = (entries(reader.json(landing)).withColumn("arrived", F.current_timestamp())
              .withWatermark("arrived", "0 seconds"))  # the time of arrival makes no row late
    changes = _changes(placed, expire_ms)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = (changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
              .foreachBatch(write_batch))
    writer = writer.trigger(availableNow=True) if available_now else writer
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)  # read when a query starts
    try:
        return writer.start()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def read_latest(spark: SparkSession, out_path: str) -> DataFrame:
    """``(user_key, item_id, rating)``: the last write of each pair over all batches."""
    return (spark.read.schema(_OUT).parquet(out_path).groupBy("user_key", "item_id")
            .agg(F.max_by("rating", "written").alias("rating")))

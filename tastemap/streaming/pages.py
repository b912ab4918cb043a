"""Streaming ingest of landed user-list pages (S3 as a file stream).

Pages land as JSON files in a folder; a file stream with the page schema
explodes them into rated entries and appends them to a parquet sink.  The
sink's commit log makes the output exactly-once across restarts, and readers
of the sink folder see committed files only.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import schemas
from ..sources.json_pages import ingest


def run_ingest(spark: SparkSession, landing: str, out_path: str, checkpoint: str,
               available_now: bool = True, files_per_trigger: int | None = None):
    """Start (and with ``available_now`` finish) the ingest stream; returns the query."""
    reader = spark.readStream.schema(schemas.LIST_PAGE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rated = ingest(reader.json(landing))
    writer = (rated.writeStream.format("parquet").outputMode("append")
              .option("path", out_path).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()

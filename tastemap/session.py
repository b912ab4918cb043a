"""Spark session and shared-folder helpers.

Every job writes intermediate tables (landed JSON pages, stream output,
model snapshots) below the shared folder the cluster names in
``spark.checkpoint.dir``.  The setting is read from the session; a local
default is made only when it is unset and the master is local (tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "tastemap", **conf) -> SparkSession:
    """A session with the defaults above; ``conf`` goes before them, and what the
    cluster's own configuration submits (the master, say) stays unless given here."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is unset: name a shared folder for the cluster"
            )
        configured = tempfile.mkdtemp(prefix="tastemap-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_root(spark: SparkSession) -> str:
    """The configured shared folder (the parent of Spark's own checkpoint subfolder)."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return os.path.dirname(ensure_checkpoint_dir(spark).rstrip("/"))


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new, never-used folder below the shared root for one run of one job."""
    return f"{shared_root(spark)}/tastemap/{kind}/{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a statement when it has ended; else they stay until the driver's JVM
#: happens to collect its garbage, and the disk holds those of every step so far.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Statements inside leave no shuffle files; a plan that is run again makes its shuffles anew."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` once as a parquet table below the shared root and read it back.

    Cuts lineage like ``checkpoint()`` but computes ``df`` a single time (an
    eager checkpoint of an uncached input computes it twice); later counts and
    joins read the small written table instead of re-running its upstream.
    What it shuffled goes as soon as it is written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    with shuffles_removed(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder below that of the intermediate tables, and nothing else."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    own = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/tastemap")).toUri().getPath()
    if not fs.makeQualified(path).toUri().getPath().startswith(own + "/"):
        raise ValueError(f"{folder} is not an intermediate table")
    fs.delete(path, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote, when all that reads them has been written, too."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)

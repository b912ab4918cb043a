"""Fold-in of the users whose ratings changed, stored factors for the rest.

Users are hashed into a fixed number of buckets.  A run stores each bucket's
row count and order-free hash of its ratings, and which run holds its folded-in
users.  The next run over the same model folds in the buckets whose ratings
differ and points to the earlier runs for the others, so it writes only what
changed.  Another model (or another penalty) has another print and starts anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources import snapshot as SN
from .foldin import foldin

#: Buckets of users: the tables of prints, which are broadcast, have a row for each at most.
BUCKETS = 1024
PRINTS, FOLDED = "user_prints", "folded_users"


def _hash(*columns: str):
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))


def _with_bucket(ratings: DataFrame, buckets: int) -> DataFrame:
    return ratings.withColumn("bucket", F.pmod(F.xxhash64("user_key"), F.lit(buckets)).cast("int"))


def model_print(item_factors: DataFrame, lam: float, k: int) -> str:
    """Row count and an order-free hash of the item factors, with the parameters of the fold-in."""
    row = item_factors.agg(F.count(F.lit(1)).alias("n"), _hash("item_id", "features").alias("h")).first()
    return f"{row['n']}:{row['h'] or 0}:{lam!r}:{k}"


def refresh(ratings: DataFrame, item_factors: DataFrame, lam: float, k: int, root: str,
            buckets: int = BUCKETS) -> str:
    """Folds every user of ``ratings(user_key, item_id, rating)`` in, as far as the latest
    complete run below ``root`` can't serve; returns the new run's id.

    ``ratings`` is read twice; a computed table should be written before.
    """
    spark = ratings.sparkSession
    model = model_print(item_factors, lam, k)
    previous = SN.latest_run(spark, root, model=model, buckets=buckets)
    run = SN.new_run_id()
    dealt = _with_bucket(ratings.select("user_key", "item_id", "rating"), buckets)
    prints = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), _hash("user_key", "item_id", "rating").alias("h"))
    if previous is None:
        decided = prints.withColumn("run", F.lit(run))
    else:
        old = F.broadcast(SN.read_table(spark, root, previous, PRINTS)).alias("o")
        same = (F.col("p.n") == F.col("o.n")) & (F.col("p.h") == F.col("o.h"))
        decided = prints.alias("p").join(old, F.col("p.bucket") == F.col("o.bucket"), "left").select(
            "p.bucket", "p.n", "p.h", F.when(same, F.col("o.run")).otherwise(F.lit(run)).alias("run"))
    SN.write_table(decided.coalesce(1), root, run, PRINTS)
    changed = SN.read_table(spark, root, run, PRINTS).where(F.col("run") == run).select("bucket")
    todo = materialize(dealt.join(F.broadcast(changed), "bucket", "left_semi").drop("bucket"), "changed_ratings")
    SN.write_table(_with_bucket(foldin(todo, item_factors, lam, k), buckets), root, run, FOLDED)
    SN.write_params(spark, root, run, {"model": model, "buckets": buckets})
    return run


def folded_users(spark: SparkSession, root: str, run: str) -> DataFrame:
    """``(user_key, n, features, rated)`` of a complete run: each bucket from the run that holds it."""
    prints = SN.read_table(spark, root, run, PRINTS)
    out = None
    for row in prints.select("run").distinct().collect():  # at most one run per bucket
        own = SN.read_table(spark, root, row["run"], FOLDED).join(
            F.broadcast(prints.where(F.col("run") == row["run"]).select("bucket")), "bucket", "left_semi")
        out = own if out is None else out.unionByName(own)
    return (SN.read_table(spark, root, run, FOLDED) if out is None else out).drop("bucket")

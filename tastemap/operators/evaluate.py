"""Ranking evaluation of recommendations (M9): leave the last rating out, look where it is ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leave_last_out(raw_with_order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ratings without each user's last rated item, ``(user_key, item_id)`` of the last ones).

    ``raw_with_order`` is ``(user_key, item_id, rating, seq)``; the last write
    of a pair counts, and of a user's pairs the one written last is left out
    (the greater item of equal ones).  Users of a single item are only left out.
    """
    last = raw_with_order.where(F.col("rating") > 0).groupBy("user_key", "item_id").agg(
        F.max_by("rating", "seq").alias("rating"), F.max("seq").alias("seq"))
    held = (last.groupBy("user_key").agg(F.max(F.struct("seq", "item_id")).alias("last"))
            .select("user_key", F.col("last.item_id").alias("item_id")))
    return last.join(held, ["user_key", "item_id"], "left_anti").drop("seq"), held


def ranking_metrics(recommended: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """One row: users with a held-out item and recommendations, hits in the first ``k``,
    hit_rate, precision (hits / k per user), mrr and ndcg, all means over those users.

    ``recommended`` is ``(user_key, item_id, rank)``, at most one row per rank.
    """
    top = recommended.where(F.col("rank") <= k)
    users = top.select("user_key").distinct().join(held, "user_key", "left_semi")
    hit = top.join(held, ["user_key", "item_id"]).select("user_key", "rank")
    each = users.join(hit, "user_key", "left").groupBy("user_key").agg(F.min("rank").alias("rank"))
    found = F.col("rank").isNotNull()

    def mean(value):
        return F.avg(F.when(found, value).otherwise(0.0))

    return each.agg(F.count(F.lit(1)).alias("users"), F.count("rank").alias("hits"),
                    mean(F.lit(1.0)).alias("hit_rate"), mean(F.lit(1.0 / k)).alias("precision"),
                    mean(1.0 / F.col("rank")).alias("mrr"), mean(1.0 / F.log2(F.col("rank") + 1.0)).alias("ndcg"))

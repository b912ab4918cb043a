"""Ratings preparation: popularity, filters, dedupe, counts, item statistics,
dense indices and the training triples (A1-A3, A6, A7, J1-J3, P1-P3, U3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .broadcast import shuffled, sized_broadcast

# The write order: the last rating of a (user, item) pair is the one with the
# greatest value of these columns (one long here, see sources.tables.write_seq).
ORDER_COLS = ("seq",)


def rated_only(ratings: DataFrame) -> DataFrame:
    """Keep rated rows; a plain column filter, pushed into the scan when possible."""
    return ratings.where(F.col("rating") > 0)


def popular_items(raw: DataFrame, min_count: int) -> DataFrame:
    """A1: items with at least ``min_count`` rows, unrated rows counted too (Q1)."""
    return (raw.groupBy("item_id")
            .agg(F.count(F.lit(1)).alias("rating_count"))
            .where(F.col("rating_count") >= min_count))


def canonical_ratings(raw_with_order: DataFrame, order_cols=ORDER_COLS) -> DataFrame:
    """A7 after P1: one row per (user, item), the last rating written wins.

    ``max_by`` is an ordinary aggregate, so a pair repeated in many rows is
    combined map-side before the shuffle.  With one order column it runs as a
    hash aggregate; several columns are compared as a struct (sort aggregate).
    """
    order = (F.col(order_cols[0]) if len(order_cols) == 1
             else F.struct(*[F.col(c) for c in order_cols]))
    last = F.max_by("rating", order)
    return (rated_only(raw_with_order)
            .groupBy("user_key", "item_id")
            .agg(last.alias("rating")))


def training_ratings(raw_with_order: DataFrame, min_count: int,
                     popular: DataFrame | None = None) -> DataFrame:
    """Canonical ratings restricted to popular items (left semi join).

    The popular-item table (one small row per item; pass it when already
    written) is written once, so its size is measured without another pass
    over the ratings; it is broadcast only when that size allows, else the
    semi join shuffles.
    """
    if popular is None:
        popular = materialize(popular_items(raw_with_order.select("item_id"), min_count),
                              "popular_items")
    popular = sized_broadcast(popular.select("item_id"), row_bytes=16)
    return canonical_ratings(raw_with_order).join(popular, "item_id", "left_semi")


def dataset_counts(ratings: DataFrame, approximate: bool = False, rsd: float = 0.01) -> DataFrame:
    """A3: ratings, users and items of a ratings table.

    Exact distinct counts are a plain distinct each, so no row is repeated per
    count; ``approximate`` uses HyperLogLog++ sketches (relative error ``rsd``)
    merged map-side, one small row per task.
    """
    count = F.count(F.lit(1))
    if approximate:
        users = F.approx_count_distinct("user_key", rsd)
        items = F.approx_count_distinct("item_id", rsd)
        return ratings.agg(count.alias("n_ratings"), users.alias("n_users"), items.alias("n_items"))
    users, items = (ratings.select(c).where(F.col(c).isNotNull()).distinct().agg(count).scalar()
                    for c in ("user_key", "item_id"))
    return ratings.agg(count.alias("n_ratings")).select(
        "n_ratings", users.alias("n_users"), items.alias("n_items"))


def require_rows(df: DataFrame, what: str) -> None:
    """Fail fast on an empty input (the reference's empty-set guards)."""
    if df.isEmpty():
        raise ValueError(f"no {what} found")


def item_stats(ratings: DataFrame) -> DataFrame:
    """Average rating and number of ratings per rated item."""
    return (rated_only(ratings).groupBy("item_id")
            .agg(F.avg("rating").alias("average_rating"),
                 F.count(F.lit(1)).alias("num_ratings")))


def catalogue(titles: DataFrame, ratings: DataFrame) -> DataFrame:
    """Every titled item with its statistics; unrated items get a null
    average and ``num_ratings`` 0 (P8)."""
    stats = item_stats(ratings)
    return (titles.join(stats, "item_id", "left")
            .select("item_id", "title", "average_rating",
                    F.coalesce("num_ratings", F.lit(0).cast("long")).alias("num_ratings")))


def dense_index(keys: DataFrame, key: str, index: str, partitions: int | None = None) -> DataFrame:
    """A2: distinct keys -> dense 0-based index in sorted key order (Q2).

    Keys are range-partitioned and sorted, each row takes its position in its
    partition, and one small table of per-partition counts (one row per
    partition) gives the offsets.  No global window pulls all keys into one
    task.  The positioned keys are written once (``materialize``) so both
    uses read one layout and the keys are computed a single time.
    """
    spark = keys.sparkSession
    partitions = partitions or spark.sparkContext.defaultParallelism
    positioned = (keys.select(key).where(F.col(key).isNotNull()).distinct()
                  .repartitionByRange(partitions, key)
                  .sortWithinPartitions(key)
                  .withColumn("_pid", F.spark_partition_id())
                  .withColumn("_mid", F.monotonically_increasing_id()))
    positioned = materialize(positioned, "dense_index")
    per_part = positioned.groupBy("_pid").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    offsets = per_part.select(
        "_pid", "_first",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    offsets = F.broadcast(offsets.fillna(0, ["_off"]))  # one row per partition
    return (positioned.join(offsets, "_pid")
            .select(key, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("int").alias(index)))


def extend_index(index: DataFrame, keys: DataFrame, key: str, number: str) -> DataFrame:
    """A2 for a later snapshot: ``index(key, number)`` with the keys it lacks numbered
    behind its largest, in key order; the numbers it has stay, those of keys that
    are gone, too, so factors stored under them keep their meaning.

    ``index`` should be a written table.
    """
    known = index.select(key)
    fresh = dense_index(keys.select(key).join(known, key, "left_anti"), key, number)
    first = index.agg(F.coalesce(F.max(number) + 1, F.lit(0))).first()[0]
    kind = index.schema[number].dataType
    return index.select(key, number).unionByName(
        fresh.withColumn(number, (F.col(number) + F.lit(first)).cast(kind)))


def training_triples(ratings: DataFrame, user_index: DataFrame, item_index: DataFrame) -> DataFrame:
    """D3 via J2/J3 and P3: ``(user int, item int, rating float)``.

    The item index is small (one row per item) and broadcast behind a size
    check; the user index joins by shuffle.
    """
    items = sized_broadcast(item_index, row_bytes=16)
    return (ratings.join(shuffled(user_index), "user_key").join(items, "item_id")
            .select(F.col("user").cast("int"), F.col("item").cast("int"),
                    F.col("rating").cast("float")))

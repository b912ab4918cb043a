"""Readers for the given parquet tables and the views derived from them.

Each reader selects only the columns it needs, so the parquet scan prunes
(``ReadSchema``) and later filters push into it (``PushedFilters``).

How the engine's inputs map onto the given tables (fixed by FIXTURES.md §2):

* ratings (D1): ``lineitem`` joined to ``orders`` on the order key;
  user = ``o_custkey``, item = ``l_partkey``,
  rating = ``CAST(floor(l_quantity / 5) AS INT)``.
* catalogue titles (D2): ``part``; item = ``p_partkey``, title = ``p_name``.
* factor vectors (D5): ``embeddings``; id = ``vec_id``, features = ``embedding``.
* request log (T1): ``events``; client = ``user_id``, endpoint = ``event_type``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.broadcast import shuffled

# Fixed value: the rating derived from a line's quantity is floor(quantity / RATING_STEP).
RATING_STEP = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_seq() -> "F.Column":
    """The write order ``(l_orderkey, l_linenumber, l_quantity)`` as one number,
    so "last write wins" is a ``max_by`` over a fixed-width key (hash
    aggregation, not sort aggregation).

    An order key has up to 63 bits and a sign, a line number 32, and of the
    quantity only the rating made from it can matter: 31 bits (a rating below
    zero is no rating).  Together they stay below 10^38, so every row has its
    place.  A null counts as 0.
    """
    order, line = (F.coalesce(F.col(c), F.lit(0)).cast("decimal(20,0)") for c in ("l_orderkey", "l_linenumber"))
    rating = F.greatest(F.coalesce(F.floor(F.col("l_quantity") / RATING_STEP), F.lit(0)), F.lit(0)).cast("decimal(20,0)")

    def times(bits: int):
        return F.lit(str(1 << bits)).cast("decimal(20,0)")

    low = (line + times(31)) * times(31) + F.least(rating, times(31) - 1)
    return (order * times(63) + low).cast("decimal(38,0)")


def raw_ratings(spark: SparkSession, sf_dir: str, with_order: bool = False,
                rated: bool = False) -> DataFrame:
    """Rating rows, zeros (listed, not rated) and duplicates included.

    ``with_order`` adds ``seq``, the write order used to pick the last rating
    of a repeated (user, item) pair.  ``rated`` keeps rated rows only, stated
    on the stored column (``l_quantity >= RATING_STEP``, the same as
    ``rating > 0``) so the parquet scan receives it as a pushed filter.
    """
    # A rating needs a user and an item; stating it here (not leaving it to the
    # joins to infer) gives every use of this view the same scan, so Spark can
    # reuse one shuffle when a plan reads the ratings twice.
    line = (table(spark, sf_dir, "lineitem")
            .select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
            .where(F.col("l_partkey").isNotNull()))
    if rated:
        line = line.where(F.col("l_quantity") >= RATING_STEP)
    orders = (table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
              .where(F.col("o_custkey").isNotNull()))
    # An order in a file of two narrow columns takes a few bits, in a broadcast's hash table dozens of bytes.
    joined = line.join(shuffled(orders), line.l_orderkey == orders.o_orderkey)
    cols = [
        F.col("o_custkey").alias("user_key"),
        F.col("l_partkey").alias("item_id"),
        F.floor(F.col("l_quantity") / RATING_STEP).cast("int").alias("rating"),
    ]
    if with_order:
        cols.append(write_seq().alias("seq"))
    return joined.select(*cols)


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title")
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_key"))


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, features array<float>)`` from the embeddings table."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features")
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ts timestamp, client, endpoint)``; ``ts`` is stored without a zone."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("client"),
        F.col("event_type").alias("endpoint"),
    )


def jdbc_ratings(spark: SparkSession, url: str, table_name: str, partition_column: str,
                 lower: int, upper: int, partitions: int, properties: dict | None = None) -> DataFrame:
    """S1 from a database: a partitioned JDBC read, ``partitions`` parallel range
    queries on ``partition_column`` (the database's driver must be on the
    classpath).  Columns: ``user_key, item_id, rating``."""
    return (spark.read.format("jdbc")
            .options(url=url, dbtable=table_name, partitionColumn=partition_column,
                     lowerBound=str(lower), upperBound=str(upper),
                     numPartitions=str(partitions), **(properties or {}))
            .load()
            .select("user_key", "item_id", F.col("rating").cast("int")))

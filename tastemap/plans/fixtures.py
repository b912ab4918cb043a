"""Model views over the given tables (FIXTURES.md §2), shared by the registered
queries, the bench and the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import ratings as R
from ..operators.broadcast import shuffled
from ..fixed import ALS_REGULARIZATION
from ..operators.train import ALSParams
from ..session import materialize
from ..sources import tables

# Fixed values of the fixture mapping (FIXTURES.md §2).
MIN_RATINGS = 30          # popularity threshold: rows per item
FOLDIN_RANK = 2           # k of the closed-form fold-in model
REGULARIZATION = ALS_REGULARIZATION
SEARCH_TERMS = ["an", "blu", "NVIL", "zzz"]
QUOTA_WINDOW = "1 day"
QUOTA_LIMIT = 2
ITEM_BASE_URL = "/items/"
LISTED_BRAND = "Brand#1"   # whose parts the small catalogue lists
# ALS with the default parameters but the fixture's popularity threshold.
ALS_PARAMS = ALSParams(min_ratings=MIN_RATINGS)
FULL_RANK = 64            # values of an embedding


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    return R.canonical_ratings(tables.raw_ratings(spark, sf, with_order=True, rated=True))


def canonical_written(spark: SparkSession, sf: str) -> DataFrame:
    """The canonical ratings written once to the shared folder, for queries
    that read them more than once (fold-in, statistics, validation): one
    dedupe pass over the ratings instead of one per use."""
    return materialize(canonical(spark, sf), "canonical_ratings")


def catalogue(spark: SparkSession, sf: str, ratings: DataFrame | None = None) -> DataFrame:
    """D2 from ``part`` and the canonical ratings (given, or derived here)."""
    ratings = canonical(spark, sf) if ratings is None else ratings
    return R.catalogue(tables.titles(spark, sf), ratings)


def similarity_factors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(item factors, user factors) of the similarity model.

    The fixture stores both sides in one embeddings table: even ``vec_id``
    rows play the items and odd ones the users (FIXTURES.md §2).  This is the
    role of each row, not a sample: every row is used.
    """
    emb = tables.embedding_vectors(spark, sf)
    role = F.pmod(F.col("id"), F.lit(2))
    return emb.where(role == 0), emb.where(role == 1)


def vector_users(spark: SparkSession, sf: str, ratings: DataFrame) -> DataFrame:
    """``(user_key, features, rated)``: odd embeddings as the vectors of the users with
    their ids, all 64 values, and the items that each has rated."""
    users = tables.embedding_vectors(spark, sf).where(F.pmod(F.col("id"), F.lit(2)) == 1)
    rated = ratings.groupBy("user_key").agg(F.collect_list("item_id").alias("rated"))
    return (users.join(shuffled(rated), users.id == rated.user_key, "left")
            .select(F.col("id").alias("user_key"), V.as_doubles("features").alias("features"),
                    F.coalesce("rated", F.array().cast("array<bigint>")).alias("rated")))


def foldin_item_factors(spark: SparkSession, sf: str, k: int = FOLDIN_RANK) -> DataFrame:
    """``(item_id, features array<double>)``: every embedding, whole or with its values added up to ``k``."""
    whole = k == FULL_RANK
    return tables.embedding_vectors(spark, sf).select(
        F.col("id").alias("item_id"),
        (V.as_doubles("features") if whole else V.folded("features", FULL_RANK, k)).alias("features"))

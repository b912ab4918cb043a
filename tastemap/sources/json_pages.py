"""User-list JSON pages (S3, D8): landing and ingest.

A landed page is one JSON line ``{user_key, page, data: [{node: {id},
list_status: {score?}}], paging: {next?}}``.  Ingest reads the pages with an
explicit schema, explodes the entries, reads a missing score as 0 and keeps
rated entries only; a page without ``paging.next`` is the user's last (Q20).  User keys are text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..fixed import LIST_PAGE_ENTRIES
from ..operators.positions import with_positions


def land_pages(ratings: DataFrame, path: str, page_entries: int = LIST_PAGE_ENTRIES,
               spread_cols: tuple[str, ...] = ()) -> str:
    """Write a ratings table as user-list pages below ``path``; returns the path.

    A user's entries are numbered in the order of ``spread_cols`` (e.g. the
    write order) and the item, and cut into pages of ``page_entries``; the last
    may be shorter.  The numbers need no per-user window (``with_positions``),
    so a long list is landed by many tasks.  An unrated entry has ``score: 0``
    or no score at all (both read as "not rated").
    """
    ratings = ratings.withColumn("user_key", F.col("user_key").cast("string"))
    placed = with_positions(ratings, [F.col("user_key"), *map(F.col, spread_cols), F.col("item_id"), F.col("rating")],
                            "list_positions", group="user_key")
    per_user = ratings.groupBy("user_key").agg(
        F.ceil(F.count(F.lit(1)) / page_entries).cast("int").alias("n_pages"))
    score = (F.when(F.col("rating") > 0, F.col("rating"))
             .when(F.pmod(F.col("item_id"), F.lit(2)) == 0, F.lit(0)))
    entries = (placed.join(per_user, "user_key")
               .withColumn("page", F.floor(F.col("position") / page_entries).cast("int"))
               .select("user_key", "page", "n_pages", "position",
                       F.struct(F.struct(F.col("item_id").alias("id")).alias("node"),
                                F.struct(score.cast("int").alias("score")).alias("list_status"))
                       .alias("entry")))
    nxt = F.when(F.col("page") + 1 < F.col("n_pages"),
                 F.format_string("list://%s?page=%d", F.col("user_key"), F.col("page") + 1))
    pages = (entries.groupBy("user_key", "page", "n_pages")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "entry"))),
                              lambda x: x["entry"]).alias("data"))
             .select("user_key", "page", "data", F.struct(nxt.alias("next")).alias("paging")))
    pages.write.mode("errorifexists").json(path)
    return path


def read_pages(spark, path: str) -> DataFrame:
    return spark.read.schema(schemas.LIST_PAGE).json(path)


def ingest(pages: DataFrame) -> DataFrame:
    """Rated entries of landed pages: ``(user_key, item_id, rating)``."""
    e = pages.select("user_key", F.explode("data").alias("e"))
    return (e.select("user_key", F.col("e.node.id").alias("item_id"),
                     F.coalesce(F.col("e.list_status.score"), F.lit(0)).alias("rating"))
            .where(F.col("rating") > 0))


def page_summary(pages: DataFrame) -> DataFrame:
    """Q20: per user, pages read, entries, rated entries, and whether the list
    is complete: all pages from 0 to the last are there, and the last alone
    has no next link."""
    per_page = pages.select(
        "user_key", "page", F.size("data").alias("entries"),
        F.size(F.filter("data", lambda e: F.coalesce(e["list_status"]["score"], F.lit(0)) > 0))
        .alias("rated"),
        F.col("paging.next").isNull().cast("int").alias("last"))
    return per_page.groupBy("user_key").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("entries").cast("long").alias("entries"),
        F.sum("rated").cast("long").alias("rated"),
        F.coalesce((F.countDistinct("page") == F.max("page") + 1)
                   & (F.min(F.when(F.col("last") == 1, F.col("page"))) == F.max("page")),
                   F.lit(False)).alias("complete"))

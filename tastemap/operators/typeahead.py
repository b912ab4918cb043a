"""Title search while a text is typed (P7, W3): a stored table of prefixes.

The table has, for every prefix of a folded title of up to ``MAX_PREFIX``
characters, its best ``n`` titles.  It is built from the longest prefixes to
the shortest: the best of a prefix are among the best of its longer ones and
the titles that end with it, so a level reads ``n`` rows a prefix of the level
below, not all titles again, and a prefix that a third of all titles share is
cut before it is shuffled.

A typed text whose prefix has ``n`` titles is answered by an equi-join with the
table: titles that start with the text come before all others.  The rest (few
titles start with it, or it is longer) go to the gram search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import SEARCH_MIN_CHARS, SEARCH_N
from ..functions import text as TX
from ..session import materialize
from .broadcast import shuffled
from .search import clean_queries, search

MAX_PREFIX = 3


def _best(rows: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("prefix").orderBy(F.desc_nulls_last("num_ratings"), "item_id")
    return (rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n))


def prefix_table(catalogue: DataFrame, n: int = SEARCH_N, max_prefix: int = MAX_PREFIX) -> DataFrame:
    """``(prefix, rank, item_id, title, average_rating, num_ratings)``; a row for each of the best
    ``n`` titles of every prefix.  A null title has no prefix.

    The catalogue should be a written table, as each level takes its short titles from it.
    """
    columns = ["item_id", "title", "average_rating", "num_ratings"]
    titles = catalogue.select(TX.fold("title").alias("tl"), *columns).where("title IS NOT NULL")
    length = F.length("tl")
    level = _best(titles.where(length >= max_prefix).select(F.substring("tl", 1, max_prefix).alias("prefix"), *columns), n)
    levels = [level]
    for size in range(max_prefix - 1, 0, -1):
        level = materialize(level, "prefix_level")
        levels[-1] = level
        longer = level.select(F.substring("prefix", 1, size).alias("prefix"), *columns)
        ending = titles.where(length == size).select(F.col("tl").alias("prefix"), *columns)
        level = _best(longer.union(ending), n)
        levels.append(level)
    out = levels[0]
    for each in levels[1:]:
        out = out.union(each)
    return out.select("prefix", "rank", *columns)


def search_typed(queries: DataFrame, catalogue: DataFrame, prefixes: DataFrame, n: int = SEARCH_N,
                 min_len: int = SEARCH_MIN_CHARS) -> DataFrame:
    """The rows of ``search`` for ``queries(qid, q)``; ``prefixes`` is a (stored) ``prefix_table`` of
    ``catalogue`` with at least ``n`` titles a prefix."""
    asked = clean_queries(queries, min_len)
    found = asked.join(shuffled(prefixes.where(F.col("rank") <= n)), asked.ql == F.col("prefix"))
    full = materialize(found.groupBy("qid").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= n).select("qid"),
                       "typed_answered")
    answered = (found.join(full, "qid", "left_semi")
                .select("qid", "rank", "item_id", "title", "average_rating", "num_ratings", F.lit(1).alias("tier")))
    rest = materialize(queries.join(full, "qid", "left_anti"), "typed_rest")
    return answered.unionByName(search(rest, catalogue, n, min_len))

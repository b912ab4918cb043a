"""Title search (M7): P6 -> J13 -> P7 -> W3, for a whole table of query texts.

Matching is literal and case-folded: a title matches when its lower-case
text contains the lower-case query (no LIKE pattern is built from user text,
so ``%``, ``_`` and ``\\`` are plain characters, Q12).  Relevance tiers:
1 the title starts with the query, 2 a word of the title starts with it
(after a space), 3 it occurs elsewhere.  Per query the top ``n`` titles by
tier, then ``num_ratings`` descending, then item id.

The substring theta join is blocked on character grams: a title containing
the query contains each of the query's 2-grams (1-gram for a one-letter
query), so each query is equi-joined to the titles holding its rarest gram
and then verified with ``contains``.  No query meets every title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import SEARCH_MIN_CHARS, SEARCH_N
from ..functions import text as TX
from ..session import materialize
from .broadcast import shuffled, sized_broadcast

GRAM = 2
QUERY_ROW_BYTES = 192  # a query's id, its text and a gram


def clean_queries(queries: DataFrame, min_len: int = SEARCH_MIN_CHARS) -> DataFrame:
    """Strip, drop blank and too-short texts; adds ``ql`` (folded query)."""
    s = TX.strip("q")
    return (queries.withColumn("_s", s)
            .where(F.length("_s") >= min_len)
            .withColumn("ql", TX.fold("_s"))
            .drop("_s"))


def title_grams(catalogue: DataFrame) -> DataFrame:
    """``(gram, item_id)``: each distinct 1- and 2-gram of each folded title."""
    tl = TX.fold("title")
    grams = F.array_union(TX.grams(tl, 1), TX.grams(tl, GRAM))
    return catalogue.select("item_id", F.explode(F.array_distinct(grams)).alias("gram"))


def candidates(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Pairs of a query and a catalogue row whose title contains it.

    The rarest gram of each query is found from the gram frequencies (a
    grouped count with map-side partial counts); hot grams in the join are
    split by AQE's skew handling, and none of the sides is broadcast by the size
    of the catalogue's file: a title has many grams.  The queries with their
    gram are written, and broadcast within a measured bound.
    """
    tg = title_grams(catalogue)
    freq = tg.groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))
    qg = queries.select(
        "qid", "ql",
        F.explode(F.array_distinct(
            F.when(F.length("ql") >= GRAM, TX.grams("ql", GRAM)).otherwise(F.array("ql"))
        )).alias("gram"))
    # per query, the (frequency, gram) pairs of its own grams (bounded by the
    # query's length); their minimum is the rarest gram, ties by gram text
    pairs = F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("f"), "gram"))
    best = (qg.join(shuffled(freq), "gram", "left")
            .groupBy("qid", "ql")
            .agg(F.array_min(pairs)["gram"].alias("gram")))
    best = materialize(best, "search_grams")
    titles = catalogue.select("item_id", "title", "average_rating", "num_ratings",
                              TX.fold("title").alias("tl"))
    return (tg.join(sized_broadcast(best, QUERY_ROW_BYTES), "gram")
            .join(shuffled(titles), "item_id")
            .where(F.col("tl").contains(F.col("ql")))
            .select("qid", "item_id", "title", "average_rating", "num_ratings", "tl", "ql"))


def search(queries: DataFrame, catalogue: DataFrame, n: int = SEARCH_N,
           min_len: int = SEARCH_MIN_CHARS) -> DataFrame:
    """Top ``n`` titles per query: ``(qid, rank, item_id, title, average_rating, num_ratings, tier)``.

    ``queries`` is ``(qid, q)``; ``catalogue`` is ``(item_id, title,
    average_rating, num_ratings)``.
    """
    q = clean_queries(queries, min_len)
    cand = candidates(q, catalogue)
    tier = (F.when(F.col("tl").startswith(F.col("ql")), 1)
            .when(F.col("tl").contains(F.concat(F.lit(" "), F.col("ql"))), 2)
            .otherwise(3))
    scored = cand.withColumn("tier", tier)
    w = Window.partitionBy("qid").orderBy("tier", F.desc_nulls_last("num_ratings"), "item_id")
    return (scored.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n)
            .select("qid", "rank", "item_id", "title", "average_rating", "num_ratings", "tier"))

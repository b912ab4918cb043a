"""Helpers the operators share: tables, native words, dense positions, components.

A *word* is a run of bytes other than 0x20 and 0x09-0x0D everywhere here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import partitions_of, with_positions  # noqa: F401 (for the operators)
from ..session import materialize
from ..sources.tables import table

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda that mentions an outer expression would compute it again for
    every element; bound as a lambda argument it is computed a single time.
    """
    return F.transform(F.array(value), body)[0]


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in ``links(a, b)``; root is the smallest node reachable.

    Each round hooks every node that has a smaller neighbour onto the smallest
    one, shortens the hooks, and contracts the links; the rounds end when no
    link is left.  Minima are combined before the shuffle, and each round's
    tables are written to the shared folder.
    """
    def ordered(df: DataFrame) -> DataFrame:
        return (df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .distinct())

    links = materialize(ordered(links), "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    roots = materialize(nodes.select("node", F.col("node").alias("root")), "roots")
    while not links.isEmpty():
        hooks = links.groupBy("a").agg(F.min("b").alias("to"))
        for _ in range(2):
            nxt = hooks.select(F.col("a").alias("_a"), F.col("to").alias("_to"))
            hooks = materialize(
                hooks.join(nxt, F.col("to") == F.col("_a"), "left")
                .select("a", F.coalesce("_to", "to").alias("to")), "hooks")
        far = hooks.select(F.col("a").alias("_a"), F.col("to").alias("_to"))

        def moved(df: DataFrame, column: str) -> DataFrame:
            return (df.join(far, F.col(column) == F.col("_a"), "left")
                    .withColumn(column, F.coalesce("_to", column)).drop("_a", "_to"))

        roots = materialize(moved(roots, "root"), "roots")
        links = materialize(ordered(moved(moved(links, "a"), "b")), "links")
    return roots

"""Broadcast only behind a measured size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Default ceiling for an explicit broadcast hint; above it a sort-merge join
# (with AQE skew splitting) is used.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
# Rows of a key from which it has no join partition of its own.
HOT_ROWS = 1 << 16


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a join side of which no size is known: never broadcast by Spark's estimate.

    The estimate is the size of the file read, however small its encoding and
    however many rows an ``explode`` makes of each of its own.
    """
    return df.hint("merge")


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int | None = None,
                   rows: int | None = None) -> bool:
    """True when ``rows * row_bytes`` (rows counted by one job if not given) is
    within ``limit`` (default ``BROADCAST_LIMIT_BYTES``)."""
    limit = BROADCAST_LIMIT_BYTES if limit is None else limit
    if rows is None:
        rows = df.count()
    return rows * row_bytes <= limit


def hot_key_join(big: DataFrame, small: DataFrame, on: str, how: str, row_bytes: int,
                 limit: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """``big`` joined (inner or left) with ``small``, of one row per key at most, where a
    key may hold any share of ``big``.

    ``small`` is written (it may be computed, and is counted); within the bound
    it is broadcast.  Above it ``big`` is written, too, and the keys of more
    than ``hot_rows`` of its rows (at most rows / ``hot_rows`` keys) meet a
    broadcast of their rows of ``small``; all others are joined by shuffle.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    small = materialize(small, "hot_key_side")
    if fits_broadcast(small, row_bytes, limit):
        return big.join(F.broadcast(small), on, how)
    big = materialize(big, "hot_key_rows")
    hot = materialize(big.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
                      .where(F.col("_n") > hot_rows).select(on), "hot_keys")
    if hot.isEmpty():
        return big.join(shuffled(small), on, how)
    few = small.join(F.broadcast(hot), on, "left_semi")
    rest = big.join(F.broadcast(hot), on, "left_anti").join(shuffled(small), on, how)
    return rest.unionByName(big.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, how))


def sized_broadcast(df: DataFrame, row_bytes: int, limit: int | None = None,
                    rows: int | None = None) -> DataFrame:
    """Return ``broadcast(df)`` when ``rows * row_bytes`` is within ``limit``.

    ``rows`` may be passed when already known; otherwise one count job
    measures it.  Over the limit the join is by shuffle.
    """
    return F.broadcast(df) if fits_broadcast(df, row_bytes, limit, rows) else shuffled(df)

"""Vector column functions on ``array<double>`` columns.

``dot``, ``norm``, ``scale`` and ``mean_vector`` are built-in higher-order
functions or aggregates that run in the JVM.  An operation that needs a
per-row scalar inside a lambda (``v / |v|``, ``v - (v.d) d``) is O(k^2) per
row as a higher-order function, because the optimizer inlines the scalar
into the lambda; those run as one Arrow-batched pandas function over whole
batches instead (``unit_projection``), O(k) per row in NumPy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a projected vector shorter than this fraction of its original
# length counts as zero (parallel to the direction, Q7).
PARALLEL_TOL = 1e-9


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def as_doubles(v) -> Column:
    """Cast any numeric array to ``array<double>`` before arithmetic."""
    return _c(v).cast("array<double>")


def narrowed(df: DataFrame, vec: str) -> DataFrame:
    """``df`` with the vectors as ``array<float>`` where each of their numbers is one, so half
    as much is shuffled and nothing rounded; else as it is.  Arithmetic with doubles widens them again."""
    wide = F.exists(vec, lambda x: ~x.eqNullSafe(x.cast("float").cast("double")))
    return df.withColumn(vec, F.col(vec).cast("array<float>")) if df.where(wide).isEmpty() else df


def folded(v, size: int, k: int) -> Column:
    """A vector of ``size`` values as ``k`` sums of neighbouring ones (``size`` is a multiple of ``k``)."""
    part = size // k

    def total(i: int) -> Column:
        return F.aggregate(F.slice(as_doubles(v), i * part + 1, part), F.lit(0.0).cast("double"), lambda a, x: a + x)

    return F.array(*[total(i) for i in range(k)])


def dot(a, b) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def scale(v, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(s)
    return F.transform(_c(v), lambda x: x * s)


def normalise(v) -> Column:
    """``v / |v|`` as a higher-order function: for one-row tables (the
    direction); O(k^2) per row, see ``unit_projection`` for tables."""
    n = norm(v)
    return F.transform(_c(v), lambda x: x / n)


def unit_projection(v, direction) -> Column:
    """``(v - (v . d) d) / |v - (v . d) d|`` for a unit direction ``d`` (a
    sequence of k floats); null when the projection vanishes (v parallel to d).

    One pandas function over Arrow batches: the batch is stacked into an
    n x k matrix and projected, measured and scaled in three NumPy steps.
    """
    d = np.asarray(direction, dtype=np.float64)

    @F.pandas_udf("array<double>")
    def project(col: pd.Series) -> pd.Series:
        if len(col) == 0:
            return pd.Series([], dtype=object)
        m = np.stack([np.asarray(x, dtype=np.float64) for x in col])
        p = m - np.outer(m @ d, d)
        n = np.linalg.norm(p, axis=1)
        keep = n > PARALLEL_TOL * np.linalg.norm(m, axis=1)
        units = p / np.where(keep, n, 1.0)[:, None]
        return pd.Series([u if ok else None for u, ok in zip(units, keep)], dtype=object)

    return project(as_doubles(v))


def mean_vector(df: DataFrame, vec: str) -> DataFrame:
    """Element-wise mean of a vector column as a one-row ``array<double>`` table.

    MLlib's summarizer adds whole vectors up in each map task; one vector per
    task is shuffled.
    """
    mean = Summarizer.mean(array_to_vector(as_doubles(vec)))
    return df.where(F.col(vec).isNotNull()).agg(vector_to_array(mean).alias("mean"))


def mean_direction(df: DataFrame, vec: str) -> DataFrame:
    """Unit-length mean of a vector column, as a one-row ``direction`` table."""
    return mean_vector(df, vec).select(normalise("mean").alias("direction"))

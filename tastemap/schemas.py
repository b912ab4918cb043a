"""Explicit schemas for every input and output table of the engine."""

from pyspark.sql import types as T

# Ratings fact table; rating 0 means "listed, not rated".
RATINGS = T.StructType([
    T.StructField("user_key", T.LongType(), True),
    T.StructField("item_id", T.LongType(), True),
    T.StructField("rating", T.IntegerType(), True),
])

# Item catalogue.
CATALOGUE = T.StructType([
    T.StructField("item_id", T.LongType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("average_rating", T.DoubleType(), True),
    T.StructField("num_ratings", T.LongType(), True),
])

# D3: training triples, the exact ALS input.
TRIPLES = T.StructType([
    T.StructField("user", T.IntegerType(), False),
    T.StructField("item", T.IntegerType(), False),
    T.StructField("rating", T.FloatType(), False),
])

# Key -> dense index tables.
USER_INDEX = T.StructType([
    T.StructField("user_key", T.LongType(), False),
    T.StructField("user", T.IntegerType(), False),
])
ITEM_INDEX = T.StructType([
    T.StructField("item_id", T.LongType(), False),
    T.StructField("item", T.IntegerType(), False),
])

# Factor tables (the schema of ALSModel.userFactors / itemFactors).
FACTORS = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("features", T.ArrayType(T.FloatType(), False), True),
])

# Mean taste direction, one unit vector.
DIRECTION = T.StructType([
    T.StructField("direction", T.ArrayType(T.DoubleType(), False), True),
])

# One landed user-list page.
LIST_PAGE = T.StructType([
    T.StructField("user_key", T.StringType(), True),
    T.StructField("page", T.IntegerType(), True),
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("node", T.StructType([T.StructField("id", T.LongType(), True)]), True),
        T.StructField("list_status", T.StructType([
            T.StructField("score", T.IntegerType(), True),
        ]), True),
    ])), True),
    T.StructField("paging", T.StructType([T.StructField("next", T.StringType(), True)]), True),
])

# Model parameters, stored beside the factor tables.
MODEL_PARAMS = T.StructType([
    T.StructField("factors", T.IntegerType(), False),
    T.StructField("iterations", T.IntegerType(), False),
    T.StructField("regularization", T.DoubleType(), False),
    T.StructField("min_ratings", T.LongType(), False),
    T.StructField("seed", T.LongType(), False),
])

# Request log for the quota audit.
REQUEST_LOG = T.StructType([
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("client", T.LongType(), True),
    T.StructField("endpoint", T.StringType(), True),
])

"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion into Spark's ``noop`` sink (every row is
computed, nothing is collected).  ``train_als_default`` fits ALS with the
reference's default parameters (rank 30, 30 iterations, lambda 0.1) on the
training set and reports training ratings per second, the one throughput the
baseline states (at least 150,000 ratings/s for about 90 M ratings).  At sf0.1
MLlib's fixed cost per iteration dominates, so ``als_scaling`` also fits the
same triples replicated ``BENCH_ALS_COPIES`` times under distinct user ids
(derived from the given data, outside the headline total) to show the
throughput once that cost is amortised.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tastemap.operators import ratings as R  # noqa: E402
from tastemap.operators import train as TR  # noqa: E402
from tastemap.plans import queries as Q  # noqa: E402
from tastemap.session import build_session, materialize  # noqa: E402
from tastemap.sources import tables  # noqa: E402

HEADLINE = [
    "ratings_canonical",
    "popularity_filtered_counts",
    "item_stats",
    "dense_index_users",
    "foldin_rank2",
    "foldin_pandas",
    "foldin_rank64",
    "recommend_rank2_top10",
    "recommend_vectors_top10",
    "report_pages",
    "similar_top5",
    "similar_blocks_top5",
    "search_top10",
    "search_title_words",
    "recommend_request_status",
    "list_pages_exploded",
    "quota_daily",
    "quota_daily_stream",
    "als_recommend_top10",
]


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", app="tastemap-bench", **{
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
        "spark.sql.shuffle.partitions": str(max(8, 2 * cpus)),
    })
    times: dict[str, float] = {}
    # warm-up: JVM start and parquet footers are not part of any query
    tables.table(spark, sf_dir, "part").count()

    for name in HEADLINE:
        t0 = time.perf_counter()
        run_noop(Q.QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)

    # Training throughput at the reference's default parameters.
    t0 = time.perf_counter()
    train = materialize(R.training_ratings(tables.raw_ratings(spark, sf_dir, with_order=True), 30),
                        "bench_training_ratings")
    ui = R.dense_index(train, "user_key", "user")
    ii = R.dense_index(train, "item_id", "item")
    triples = materialize(R.training_triples(train, ui, ii), "bench_triples")
    n_train = triples.count()
    prep = time.perf_counter() - t0
    t1 = time.perf_counter()
    model = TR.fit_als(triples, TR.ALSParams(factors=30, iterations=30, regularization=0.1,
                                             min_ratings=30))
    model.itemFactors.write.format("noop").mode("overwrite").save()
    fit = time.perf_counter() - t1
    times["train_als_default"] = round(prep + fit, 3)

    copies = int(os.environ.get("BENCH_ALS_COPIES", "10"))
    scaling = None
    if copies > 1:
        n_users = triples.agg(F.max("user")).first()[0] + 1
        big = (triples.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
               .select((F.col("user") + F.col("c") * n_users).cast("int").alias("user"),
                       "item", "rating")
               .repartition(2 * cpus))
        big = materialize(big, "bench_triples_copies")
        n_big = big.count()
        t2 = time.perf_counter()
        TR.fit_als(big, TR.ALSParams(factors=30, iterations=30, regularization=0.1,
                                     min_ratings=30)).itemFactors \
            .write.format("noop").mode("overwrite").save()
        big_fit = time.perf_counter() - t2
        scaling = {"copies": copies, "ratings": n_big, "fit_sec": round(big_fit, 3),
                   "ratings_per_sec": round(n_big / big_fit, 1)}

    total = round(sum(times.values()), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(sf.group(1)) if sf else sf_dir,
        "train_ratings": n_train,
        "train_ratings_per_sec": round(n_train / fit, 1) if fit > 0 else None,
        "als_scaling": scaling,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Refresh of changed users, stable indices, mergeable statistics."""

import numpy as np
from pyspark.sql import functions as F

from tastemap.operators import partials as PT
from tastemap.operators import ratings as R
from tastemap.operators import refresh as RF
from tastemap.operators.foldin import foldin
from tastemap.sources import snapshot as SN

LAM, K = 0.1, 3


def data(spark, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(u, int(i), int(rng.integers(1, 11))) for u in range(120) for i in rng.choice(50, 8, replace=False)]
    items = spark.createDataFrame([(i, rng.normal(size=K).tolist()) for i in range(50)], "item_id long, features array<double>")
    return rows, items


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_key long, item_id long, rating int")


def vectors(df):
    return {r.user_key: (r.n, tuple(np.round(r.features, 9)), tuple(sorted(r.rated))) for r in df.collect()}


def test_only_changed_buckets_are_folded_in(spark, tmp_root):
    rows, items = data(spark)
    first = RF.refresh(frame(spark, rows), items, LAM, K, tmp_root, buckets=32)
    # one user rates again, one leaves, one is new
    now = [r for r in rows if r[0] != 7] + [(3, 49, 1), (3, 48, 2), (500, 1, 9)]
    now = list({(u, i): (u, i, x) for u, i, x in now}.values())
    second = RF.refresh(frame(spark, now), items, LAM, K, tmp_root, buckets=32)
    assert vectors(RF.folded_users(spark, tmp_root, second)) == vectors(foldin(frame(spark, now), items, LAM, K))
    assert vectors(RF.folded_users(spark, tmp_root, first)) == vectors(foldin(frame(spark, rows), items, LAM, K))
    prints = SN.read_table(spark, tmp_root, second, RF.PRINTS)
    assert 1 <= prints.where(F.col("run") == second).count() <= 3
    written = SN.read_table(spark, tmp_root, second, RF.FOLDED).select("bucket").distinct().count()
    assert written <= 3
    third = RF.refresh(frame(spark, now), items, LAM, K, tmp_root, buckets=32)   # nothing changed
    assert SN.read_table(spark, tmp_root, third, RF.FOLDED).count() == 0
    assert vectors(RF.folded_users(spark, tmp_root, third)) == vectors(RF.folded_users(spark, tmp_root, second))


def test_another_model_or_penalty_starts_anew(spark, tmp_root):
    rows, items = data(spark)
    RF.refresh(frame(spark, rows), items, LAM, K, tmp_root, buckets=8)
    other = items.withColumn("features", F.transform("features", lambda x: x + 1))
    for run, model, lam in ((RF.refresh(frame(spark, rows), other, LAM, K, tmp_root, buckets=8), other, LAM),
                            (RF.refresh(frame(spark, rows), items, 0.5, K, tmp_root, buckets=8), items, 0.5)):
        assert vectors(RF.folded_users(spark, tmp_root, run)) == vectors(foldin(frame(spark, rows), model, lam, K))
        assert SN.read_table(spark, tmp_root, run, RF.PRINTS).where(F.col("run") != run).count() == 0


def test_index_keeps_its_numbers(spark, tmp_root):
    first = R.dense_index(spark.createDataFrame([("b",), ("d",), (None,)], "k string"), "k", "n")
    first.write.parquet(tmp_root)
    index = spark.read.parquet(tmp_root)
    more = R.extend_index(index, spark.createDataFrame([("a",), ("d",), ("c",), ("a",), (None,)], "k string"), "k", "n")
    assert {r.k: r.n for r in more.collect()} == {"b": 0, "d": 1, "a": 2, "c": 3}
    empty = R.extend_index(index.where("false"), index, "k", "n")
    assert {r.k: r.n for r in empty.collect()} == {"b": 0, "d": 1}
    assert R.extend_index(index, index, "k", "n").count() == 2


def test_partial_tables_merge(spark, tmp_root):
    rows, _ = data(spark)
    rows += [(1000, 1, 0)]   # listed, not rated
    for part in range(3):
        PT.append_batch(frame(spark, [r for r in rows if r[0] % 3 == part]), tmp_root, str(part))
    PT.append_batch(frame(spark, [r for r in rows if r[0] % 3 == 0]), tmp_root, "0")   # a batch written again
    got = {r.item_id: (round(r.average_rating, 9), r.num_ratings) for r in PT.merged_stats(spark, tmp_root).collect()}
    want = {r.item_id: (round(r.average_rating, 9), r.num_ratings) for r in R.item_stats(frame(spark, rows)).collect()}
    assert got == want
    for r in PT.merged_stats(spark, tmp_root).collect():
        assert abs(r.distinct_users - r.num_ratings) <= 1
    total = PT.dataset_totals(spark, tmp_root).first()
    assert (total.n_ratings, total.n_items) == (960, 50) and abs(total.n_users - 120) <= 4

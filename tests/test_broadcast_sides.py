"""Join sides that Spark would broadcast by the size of their file."""

import pytest

from tastemap.operators import broadcast as BC
from tastemap.operators import search as SE
from tastemap.operators import similar as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_limit(monkeypatch):
    monkeypatch.setattr(BC, "BROADCAST_LIMIT_BYTES", 0)


def test_hot_key_join_broadcasts_hot_keys_only(spark, no_limit):
    small = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "k long, t string")
    rows = [(1, i) for i in range(40)] + [(2, 0), (9, 0), (None, 0)]
    big = spark.createDataFrame(rows, "k long, v long")
    for how in ("inner", "left"):
        got = BC.hot_key_join(big, small, "k", how, 128, hot_rows=10)
        want = big.join(small, "k", how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "BroadcastHashJoin" not in plan(BC.hot_key_join(big, small, "k", "left", 128))


def test_similar_sources_are_not_broadcast_by_estimate(spark, no_limit):
    cat = spark.createDataFrame([(i, f"t{i}", 1.0, 1) for i in range(4)],
                                "item_id long, title string, average_rating double, num_ratings long")
    sim = spark.createDataFrame([(0, 1, 0.5, 1), (2, 3, 0.5, 1)],
                                "src_id long, item_id long, similarity double, rank int")
    out = S.enrich_similar(sim, cat)
    assert "Broadcast" not in plan(out)
    assert [(r.src_title, r.title) for r in out.orderBy("src_id").collect()] == [("t0", "t1"), ("t2", "t3")]


def test_title_grams_are_not_broadcast(spark, no_limit):
    cat = spark.createDataFrame([(1, "blue ring", 1.0, 2), (2, "old bolt", 2.0, 1)],
                                "item_id long, title string, average_rating double, num_ratings long")
    queries = spark.createDataFrame([("a", "bl"), ("b", "LT")], "qid string, q string")
    out = SE.search(queries, cat, 5)
    assert "Broadcast" not in plan(out)
    assert sorted((r.qid, r.item_id, r.tier) for r in out.collect()) == [("a", 1, 1), ("b", 2, 3)]


def test_orders_are_not_broadcast_by_the_size_of_their_file(spark, tmp_root):
    from tastemap.sources import tables
    spark.createDataFrame([(i, i % 7) for i in range(50)], "o_orderkey long, o_custkey long").write.parquet(
        f"{tmp_root}/orders.parquet")
    spark.createDataFrame([(i // 2, i % 11, i % 2, float(i)) for i in range(100)],
                          "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(
        f"{tmp_root}/lineitem.parquet")
    df = tables.raw_ratings(spark, tmp_root, with_order=True)
    assert "Broadcast" not in plan(df)
    assert sorted((r.user_key, r.item_id, r.rating) for r in df.collect()) == sorted(
        ((i // 2) % 7, i % 11, i // 5) for i in range(100))

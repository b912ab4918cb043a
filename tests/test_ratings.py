from pyspark.sql import functions as F

from tastemap.operators import ratings as R
from tastemap.sources.tables import write_seq

RAW = "user_key long, item_id long, rating int, l_orderkey long, l_linenumber int, l_quantity double"


def raw_df(spark, rows):
    """Rows with the composite write order, plus ``seq`` as the source makes it."""
    return spark.createDataFrame(rows, RAW).withColumn("seq", write_seq())


def test_zero_only_item_passes_popularity_but_not_training(spark):
    rows = [(u, 1, 0, u, 1, 1.0) for u in range(3)] + [(u, 2, 4, u, 2, 20.0) for u in range(3)]
    raw = raw_df(spark, rows)
    popular = {r.item_id for r in R.popular_items(raw, 3).collect()}
    assert popular == {1, 2}
    train = R.training_ratings(raw, 3).collect()
    assert {r.item_id for r in train} == {2}


def test_item_with_exactly_min_count_is_kept(spark):
    rows = [(u, 7, 3, u, 1, 15.0) for u in range(5)] + [(u, 8, 3, u, 2, 15.0) for u in range(4)]
    popular = {r.item_id for r in R.popular_items(raw_df(spark, rows), 5).collect()}
    assert popular == {7}


def test_same_pair_rated_twice_last_one_counts(spark):
    rows = [(1, 5, 2, 10, 1, 10.0), (1, 5, 9, 11, 1, 45.0), (1, 5, 4, 10, 2, 20.0)]
    out = R.canonical_ratings(raw_df(spark, rows)).collect()
    assert [(r.user_key, r.item_id, r.rating) for r in out] == [(1, 5, 9)]


def test_dedupe_ties_on_order_use_quantity(spark):
    rows = [(1, 5, 2, 10, 1, 10.0), (1, 5, 3, 10, 1, 15.0)]
    out = R.canonical_ratings(raw_df(spark, rows)).collect()
    assert out[0].rating == 3


def test_dedupe_on_composite_order_columns(spark):
    rows = [(1, 5, 2, 10, 1, 10.0), (1, 5, 9, 11, 1, 45.0), (1, 5, 4, 10, 2, 20.0),
            (2, 5, 7, 3, 9, 35.0), (2, 5, 1, 3, 2, 5.0)]
    cols = ("l_orderkey", "l_linenumber", "l_quantity")
    out = sorted((r.user_key, r.rating) for r in R.canonical_ratings(raw_df(spark, rows), cols).collect())
    assert out == [(1, 9), (2, 7)]


def test_write_seq_orders_every_row(spark):
    big = 2 ** 63 - 1
    rows = [(-big, 2 ** 31 - 1, 50.0), (-1, 0, 5.0), (0, -5, 5.0), (None, None, None), (0, 0, 5.0), (1, 7, 50.0),
            (1, 9, 5.0), (1, 9, 64.5), (1, 9, 1e300), (1, 2 ** 31 - 1, 5.0), (2, -2 ** 31, 5.0), (big, 2 ** 31 - 1, 64.5)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double")
    seq = [r[0] for r in df.select(write_seq()).collect()]
    assert seq == sorted(seq) and len(set(seq)) == len(rows)


def test_last_write_wins_beyond_line_seven_and_whole_quantities(spark, tmp_root):
    from tastemap.sources import tables
    lines = [(1, 5, 9, 64.5), (1, 5, 7, 20.0), (1, 5, 9, 11.0), (2, 6, 100000, 0.5), (2, 6, 3, 33.3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(
        f"{tmp_root}/lineitem.parquet")
    spark.createDataFrame([(1, 10), (2, 10)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_root}/orders.parquet")
    raw = tables.raw_ratings(spark, tmp_root, with_order=True, rated=True)
    out = R.canonical_ratings(raw)
    assert sorted((r.user_key, r.item_id, r.rating) for r in out.collect()) == [(10, 5, 12), (10, 6, 6)]
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_dataset_counts_one_pass(spark):
    rows = [(1, 1, 3, 1, 1, 1.0), (1, 2, 3, 1, 2, 1.0), (2, 2, 3, 2, 1, 1.0)]
    for approximate in (False, True):
        c = R.dataset_counts(raw_df(spark, rows), approximate=approximate).first()
        assert (c.n_ratings, c.n_users, c.n_items) == (3, 2, 2)


def test_dense_index_is_sorted_bijection(spark):
    keys = spark.range(0, 5000).select((F.col("id") * 7919 % 100003).alias("k"))
    idx = R.dense_index(keys, "k", "i", partitions=7).toPandas().sort_values("k")
    assert list(idx["i"]) == list(range(len(idx)))
    assert idx["k"].is_unique and len(idx) == 5000


def test_catalogue_unrated_item_has_null_average(spark):
    titles = spark.createDataFrame([(1, "a"), (2, "b")], "item_id long, title string")
    ratings = spark.createDataFrame([(9, 1, 4), (8, 1, 2)], "user_key long, item_id long, rating int")
    cat = {r.item_id: r for r in R.catalogue(titles, ratings).collect()}
    assert cat[1].average_rating == 3.0 and cat[1].num_ratings == 2
    assert cat[2].average_rating is None and cat[2].num_ratings == 0


def test_training_triples_types(spark):
    ratings = spark.createDataFrame([(10, 100, 4), (20, 100, 5)], "user_key long, item_id long, rating int")
    ui = R.dense_index(ratings, "user_key", "user")
    ii = R.dense_index(ratings, "item_id", "item")
    t = R.training_triples(ratings, ui, ii)
    assert [f.dataType.simpleString() for f in t.schema] == ["int", "int", "float"]
    assert sorted((r.user, r.item, r.rating) for r in t.collect()) == [(0, 0, 4.0), (1, 0, 5.0)]

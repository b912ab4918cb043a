"""The stored prefix table against the gram search; leave-last-out metrics by hand."""

import math

import pytest

from tastemap.operators import evaluate as EV
from tastemap.operators import search as SE
from tastemap.operators import typeahead as TA

CATALOGUE = "item_id long, title string, average_rating double, num_ratings long"


def rows(df):
    return sorted((r.qid, r["rank"], r.item_id, r.tier) for r in df.collect())


@pytest.mark.parametrize("n", [1, 3, 10])
def test_prefix_table_answers_like_the_search(spark, tmp_root, n):
    words = ["ab", "abc", "Abd", "a", "zb ab", "Éa", "b%_", "abcd", "x abc", "ba"]
    titles = [(i, f"{words[i % 10]}{' more' * (i % 3)}", None if i % 7 else 1.0, i * 5 % 11) for i in range(90)]
    titles += [(200, None, 1.0, 3), (201, "", 1.0, 3), (202, "ab", 1.0, None)]
    spark.createDataFrame(titles, CATALOGUE).write.parquet(f"{tmp_root}/catalogue")
    catalogue = spark.read.parquet(f"{tmp_root}/catalogue")
    TA.prefix_table(catalogue, n).write.parquet(f"{tmp_root}/prefixes")
    prefixes = spark.read.parquet(f"{tmp_root}/prefixes")
    assert prefixes.groupBy("prefix").count().agg({"count": "max"}).first()[0] <= n
    texts = ["a", "AB", " abc ", "abcd", "z", "éa", "b%", "more", "", None, "qq", "x ", "ab m"]
    asked = spark.createDataFrame([(str(i), q) for i, q in enumerate(texts)], "qid string, q string")
    assert rows(TA.search_typed(asked, catalogue, prefixes, n)) == rows(SE.search(asked, catalogue, n))


def test_a_level_is_built_from_the_one_below(spark):
    titles = [(i, t, 1.0, n) for i, (t, n) in enumerate([("abc", 1), ("abd", 9), ("ab", 5), ("a", 7), ("bcd", 2)])]
    table = TA.prefix_table(spark.createDataFrame(titles, CATALOGUE), 2)
    got = {}
    for r in sorted(table.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.prefix, []).append(r.title)
    assert got == {"abc": ["abc"], "abd": ["abd"], "bcd": ["bcd"], "ab": ["abd", "ab"], "bc": ["bcd"],
                   "a": ["abd", "a"], "b": ["bcd"]}


def test_leave_last_out_and_metrics(spark):
    raw = spark.createDataFrame(
        [(1, 10, 5, 1), (1, 11, 6, 3), (1, 10, 7, 9), (1, 12, 0, 99), (2, 10, 3, 4), (2, 11, 3, 4), (3, 10, 1, 1)],
        "user_key long, item_id long, rating int, seq long")
    train, held = EV.leave_last_out(raw)
    assert sorted((r.user_key, r.item_id) for r in held.collect()) == [(1, 10), (2, 11), (3, 10)]
    assert sorted((r.user_key, r.item_id, r.rating) for r in train.collect()) == [(1, 11, 6), (2, 10, 3)]
    top = spark.createDataFrame([(1, 5, 1), (1, 10, 2), (2, 9, 1), (2, 8, 2), (2, 11, 3), (9, 1, 1)],
                                "user_key long, item_id long, rank int")
    m = EV.ranking_metrics(top, held, 2).first()
    assert (m.users, m.hits, m.hit_rate, m.precision, m.mrr) == (2, 1, 0.5, 0.25, 0.25)
    assert m.ndcg == pytest.approx(1 / math.log2(3) / 2)
    assert EV.ranking_metrics(top.where("false"), held, 2).first().users == 0

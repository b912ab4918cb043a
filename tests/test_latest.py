"""Last write wins as a stream over landed pages."""

import json

from tastemap.streaming import latest as PL


def land(spark, path, pages):
    lines = [json.dumps({"user_key": u, "page": p, "data": [
        {"node": {"id": i}, "list_status": {} if s is None else {"score": s}} for i, s in entries], "paging": {}})
        for u, p, entries in pages]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)


def answer(spark, base):
    return sorted((r.user_key, r.item_id, r.rating) for r in PL.read_latest(spark, f"{base}/out").collect())


def test_last_write_wins_whatever_comes_first(spark, tmp_root):
    parts = [[("u", 2, [(5, 9), (6, 0)]), ("v", 0, [(5, 1), (5, 2), (5000, 7)])],
             [("u", 0, [(5, 1), (6, 4), (7, 3)]), ("v", 1, [(5, None), (5000, 8)])],
             [("u", 1, [(5, 2), (7, 6), (7, 5)]), ("w", 0, [])]]
    for i, pages in enumerate(parts):
        land(spark, f"{tmp_root}/in/{i}", pages)
        PL.run_latest(spark, f"{tmp_root}/in", f"{tmp_root}/out", f"{tmp_root}/ckpt").awaitTermination()
    # unrated entries (0 or no score) are no writes
    assert answer(spark, tmp_root) == [("u", 5, 9), ("u", 6, 4), ("u", 7, 5), ("v", 5, 2), ("v", 5000, 8)]
    changes = spark.read.parquet(f"{tmp_root}/out")
    assert changes.where("user_key = 'u' AND item_id = 5").count() == 1   # the earlier writes came late


def test_expired_state_costs_output_only(spark, tmp_root):
    for i, (user, page) in enumerate((("u", 3), ("v", 0), ("w", 0), ("u", 1))):
        land(spark, f"{tmp_root}/in/{i}", [(user, page, [(5, page + 1)])])
        PL.run_latest(spark, f"{tmp_root}/in", f"{tmp_root}/out", f"{tmp_root}/ckpt", expire="1 ms").awaitTermination()
    assert ("u", 5, 4) in answer(spark, tmp_root)
    assert spark.read.parquet(f"{tmp_root}/out").where("user_key = 'u'").count() == 2


def test_state_is_an_aggregate_outside_the_heap(spark, tmp_root):
    land(spark, f"{tmp_root}/in/0", [("u", 0, [(5, 1)])])
    key, before = PL._STORE, spark.conf.get(PL._STORE, None)
    q = PL.run_latest(spark, f"{tmp_root}/in", f"{tmp_root}/out", f"{tmp_root}/ckpt")
    q.awaitTermination()
    state = [o for p in q.recentProgress for o in p["stateOperators"]]
    assert {o["operatorName"] for o in state} == {"stateStoreSave"} and state[-1]["numRowsTotal"] == 1
    assert any(k.startswith("rocksdb") for k in state[0]["customMetrics"])
    assert spark.conf.get(key, None) == before

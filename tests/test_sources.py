from pyspark.sql import functions as F

from tastemap.sources import json_pages as JP
from tastemap.sources import snapshot as SN


def test_pages_round_trip_and_scores(spark, tmp_root):
    rows = [("bob", i, (i % 4)) for i in range(2500)] + [("2", 5, 0), ("2", 6, 3)]
    ratings = spark.createDataFrame(rows, "user_key string, item_id long, rating int")
    path = JP.land_pages(ratings, f"{tmp_root}/pages")
    pages = JP.read_pages(spark, path)
    got = sorted((r.user_key, r.item_id, r.rating) for r in JP.ingest(pages).collect())
    assert got == sorted(r for r in rows if r[2] > 0)
    summ = {r.user_key: r for r in JP.page_summary(pages).collect()}
    assert summ["bob"].pages == 3 and summ["bob"].entries == 2500 and summ["bob"].complete
    assert summ["2"].pages == 1 and summ["2"].rated == 1


def test_page_without_score_or_next(spark, tmp_root):
    import json
    import os
    d = tmp_root.replace("file:", "") + "/hand"
    os.makedirs(d)
    with open(f"{d}/p.json", "w") as f:
        f.write(json.dumps({"user_key": 7, "page": 0, "data": [
            {"node": {"id": 1}, "list_status": {}},
            {"node": {"id": 2}, "list_status": {"score": 0}},
            {"node": {"id": 3}, "list_status": {"score": 8}}], "paging": {}}) + "\n")
    pages = JP.read_pages(spark, d)
    assert [(r.item_id, r.rating) for r in JP.ingest(pages).collect()] == [(3, 8)]
    s = JP.page_summary(pages).first()
    assert s.complete and s.rated == 1 and s.entries == 3


def test_snapshot_latest_complete_run(spark, tmp_root):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    assert SN.latest_run(spark, tmp_root) is None
    SN.write_table(df, tmp_root, "r1", "t")
    SN.write_params(spark, tmp_root, "r1", {"min_ratings": 5})
    SN.write_table(df, tmp_root, "r2", "t")              # crashed: no params
    SN.write_table(df, tmp_root, "r0", "t")
    SN.write_params(spark, tmp_root, "r0", {"min_ratings": 9})
    assert SN.latest_run(spark, tmp_root) == "r1"
    assert SN.latest_run(spark, tmp_root, min_ratings=9) == "r0"
    try:
        SN.write_table(df, tmp_root, "r1", "t")
        raise AssertionError("overwrote a run")
    except Exception as e:  # noqa: BLE001
        assert "already exists" in str(e).lower() or "PATH_ALREADY_EXISTS" in str(e)


def test_page_stream_restart_is_exactly_once(spark, tmp_root):
    from tastemap.streaming.pages import run_ingest
    r1 = spark.createDataFrame([(1, i, 3) for i in range(10)], "user_key long, item_id long, rating int")
    r2 = spark.createDataFrame([(2, i, 4) for i in range(5)], "user_key long, item_id long, rating int")
    JP.land_pages(r1, f"{tmp_root}/landing/a")
    out, ckpt = f"{tmp_root}/out", f"{tmp_root}/ckpt"
    run_ingest(spark, f"{tmp_root}/landing/*", out, ckpt).awaitTermination()
    JP.land_pages(r2, f"{tmp_root}/landing/b")
    run_ingest(spark, f"{tmp_root}/landing/*", out, ckpt).awaitTermination()
    got = sorted((r.user_key, r.item_id) for r in spark.read.parquet(out).collect())
    assert got == sorted([("1", i) for i in range(10)] + [("2", i) for i in range(5)])


def test_a_lost_page_is_seen_and_pages_are_full(spark, tmp_root):
    rows = [(u, i, 3) for u in ("a b", "ünï", "7") for i in range(23)]
    ratings = spark.createDataFrame(rows, "user_key string, item_id long, rating int")
    pages = JP.read_pages(spark, JP.land_pages(ratings, f"{tmp_root}/pages", page_entries=5))
    sizes = sorted((r.user_key, r.page, len(r.data)) for r in pages.collect())
    assert sizes == sorted((u, p, 5 if p < 4 else 3) for u in ("a b", "ünï", "7") for p in range(5))
    assert all(r.complete for r in JP.page_summary(pages).collect())
    for gone in range(5):
        left = pages.where(~((F.col("user_key") == "7") & (F.col("page") == gone)))
        assert {r.user_key: r.complete for r in JP.page_summary(left).collect()} == {"a b": True, "ünï": True, "7": False}

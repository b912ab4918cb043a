import datetime as dt

from pyspark.sql import functions as F

from tastemap.streaming import alarm as AL
from tastemap.streaming import quota as QT

SCHEMA = "ts timestamp, client long, endpoint string"


def t(h, m=0, day=1):
    return dt.datetime(2024, 1, day, h, m)


def test_batch_flags_over_quota(spark):
    rows = [(t(0, i), 1, "a") for i in range(3)] + [(t(1, 0), 1, "a"), (t(0, 5), 2, "a")]
    out = QT.over_quota(spark.createDataFrame(rows, SCHEMA), "1 hour", 2).collect()
    assert [(r.client, r.calls) for r in out] == [(1, 3)]


def test_quota_table_per_endpoint(spark):
    rows = [(t(0, i), 1, "a") for i in range(3)] + [(t(0, i), 1, "b") for i in range(3)]
    quotas = spark.createDataFrame([("a", 2), ("b", 5)], "endpoint string, quota long")
    out = QT.over_quota(spark.createDataFrame(rows, SCHEMA), "1 hour", quotas).collect()
    assert [(r.endpoint, r.calls) for r in out] == [("a", 3)]


def test_stream_drops_late_events(spark, tmp_root):
    src = tmp_root + "/src"
    first = [(t(10, i), 1, "a") for i in range(3)] + [(t(0, 1), 2, "a")]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(src + "/b1")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(src)
    q = QT.run_stream(spark, stream, tmp_root + "/out", tmp_root + "/ckpt", "1 hour",
                      watermark="30 minutes", available_now=False)
    q.processAllAvailable()
    # events of 00:xx are now far behind the watermark (10:00 - 30 min)
    late = [(t(0, 2), 2, "a"), (t(0, 3), 2, "a"), (t(10, 30), 1, "a")]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.parquet(src + "/b2")
    q.processAllAvailable()
    q.stop()
    out = {(r.client, r.window_start.hour): r.calls
           for r in QT.read_stream_result(spark, tmp_root + "/out", 0).collect()}
    assert out == {(1, 10): 4, (2, 0): 1}
    batch = QT.over_quota(spark.createDataFrame(first + late, SCHEMA), "1 hour", 0)
    assert batch.where((F.col("client") == 2)).first().calls == 3
    left = QT.uncounted(spark.createDataFrame(first + late, SCHEMA), tmp_root + "/out", "1 hour").collect()
    assert [(r.client, r.calls, r.late) for r in left] == [(2, 3, 2)]


def test_route_quotas(spark):
    rows = [(t(0, i % 60), 1, "recommendations") for i in range(31)] + \
           [(t(0, i % 60), 1, "similar") for i in range(31)]
    out = QT.over_quota(spark.createDataFrame(rows, SCHEMA), "1 hour", QT.route_quotas(spark)).collect()
    assert [(r.endpoint, r.calls, r.quota) for r in out] == [("recommendations", 31, 30)]
    every = QT.audit(spark.createDataFrame(rows, SCHEMA), "1 hour", QT.route_quotas(spark)).collect()
    assert {(r.endpoint, r.over_quota) for r in every} == {("recommendations", True), ("similar", False)}


def test_stream_restart_from_checkpoint_counts_once(spark, tmp_root):
    src, out, ckpt = tmp_root + "/src", tmp_root + "/out", tmp_root + "/ckpt"
    first = [(t(1, i), 1, "a") for i in range(3)]
    second = [(t(1, 30 + i), 1, "a") for i in range(2)] + [(t(2, 0), 2, "b")]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(src + "/b1")

    def source():
        return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(src)

    q = QT.run_stream(spark, source(), out, ckpt, "1 hour")
    q.awaitTermination()                      # available-now: first file only
    spark.createDataFrame(second, SCHEMA).coalesce(1).write.parquet(src + "/b2")
    q = QT.run_stream(spark, source(), out, ckpt, "1 hour")   # a new query, same checkpoint
    q.awaitTermination()
    got = sorted((r.client, r.endpoint, r.calls)
                 for r in QT.read_stream_result(spark, out, 0).collect())
    want = sorted((r.client, r.endpoint, r.calls)
                  for r in QT.over_quota(spark.createDataFrame(first + second, SCHEMA),
                                         "1 hour", 0).collect())
    assert got == want == [(1, "a", 5), (2, "b", 1)]


def run_parts(spark, base, parts, quota=2, **kw):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{base}/src/{i}")
        source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{base}/src")
        AL.run_alarms(spark, source, f"{base}/out", f"{base}/ckpt", "1 hour", quota, **kw).awaitTermination()
    return {(r.client, r.endpoint, r.window_start.hour): r for r in AL.read_alarms(spark, f"{base}/out").collect()}


def test_alarm_at_the_first_breach_over_restarts(spark, tmp_root):
    got = run_parts(spark, tmp_root, [
        [(t(10, 30), 1, "a"), (t(10, 10), 1, "a"), (t(10, 0), 2, "a")],
        [(t(10, 50), 1, "a"), (t(10, 40), 1, "a"), (t(10, 5), 2, "a")],
        [(t(10, 55), 1, "a"), (t(10, 1), 3, "b")]])
    one = got[1, "a", 10]
    assert (one.counted, one.late, one.alarms, one.breached_at) == (5, 0, 1, t(10, 40))
    assert [(got[k].counted, got[k].alarms, got[k].breached_at) for k in ((2, "a", 10), (3, "b", 10))] == [
        (2, 0, None), (1, 0, None)]


def test_late_calls_are_given_out_and_another_key_closes_nothing(spark, tmp_root):
    got = run_parts(spark, tmp_root, [
        [(t(0, 1), 1, "a"), (t(0, 1), 2, "a"), (t(9, 0), 1, "a")],
        [(t(0, i), 1, "a") for i in range(2, 6)] + [(t(0, 2), 2, "a"), (t(0, 3), 2, "a"), (t(8, 30), 1, "a")]],
        delay="30 minutes")
    assert {k: (r.counted, r.late, r.alarms) for k, r in got.items()} == {
        (1, "a", 0): (1, 4, 0), (1, "a", 9): (1, 0, 0), (1, "a", 8): (1, 0, 0), (2, "a", 0): (3, 0, 1)}


def test_alarms_with_a_quota_table_and_text_clients(spark, tmp_root):
    schema = "ts timestamp, client string, endpoint string"
    rows = [(t(0, i), "x", "a") for i in range(3)] + [(t(0, i), "x", "b") for i in range(3)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_root}/src")
    quotas = spark.createDataFrame([("a", 2), ("b", 5)], "endpoint string, quota long")
    AL.run_alarms(spark, spark.readStream.schema(schema).parquet(f"{tmp_root}/src"), f"{tmp_root}/out",
                  f"{tmp_root}/ckpt", "1 hour", quotas).awaitTermination()
    got = {(r.client, r.endpoint): (r.counted, r.quota, r.alarms) for r in AL.read_alarms(spark, f"{tmp_root}/out").collect()}
    assert got == {("x", "a"): (3, 2, 1), ("x", "b"): (3, 5, 0)}


def test_alarm_state_is_joined_without_a_call_per_key(spark, tmp_root, monkeypatch):
    """No Python call per key; null clients are a key, too."""
    runs = []
    windows = AL._windows
    monkeypatch.setattr(AL, "_windows", lambda *a: runs.append(windows(*a)) or runs[-1])
    got = run_parts(spark, tmp_root, [
        [(t(10, 30), 1, "a"), (t(10, 10), None, "a"), (t(10, 0), 2, None)],
        [(t(10, 50), 1, "a"), (t(10, 40), 1, "a"), (t(10, 5), None, "a"), (t(10, 6), None, "a"), (t(10, 7), 2, None)]])
    assert {k: (r.counted, r.late, r.alarms) for k, r in got.items()} == {
        (1, "a", 10): (3, 0, 1), (None, "a", 10): (3, 0, 1), (2, None, 10): (2, 0, 0)}
    assert len(runs) == 2
    for df in runs:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan

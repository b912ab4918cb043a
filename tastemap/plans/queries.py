"""

Each takes ``(spark, sf_dir)``, reads the given tables whole and returns a
DataFrame whose columns match the SQL of ``oracle.py`` by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import RECOMMEND_N_API, SEARCH_MIN_CHARS_CLIENT, SIMILAR_N_API
from ..functions import vectors as V
from ..functions.numeric import result_round
from ..operators import evaluate as EV
from ..operators import foldin as FI
from ..operators import partials as PT
from ..operators import ratings as R
from ..operators import recommend as RC
from ..operators import refresh as RF
from ..operators import report as RP
from ..operators import requests as RQ
from ..operators import search as SE
from ..operators import similar as S
from ..operators import train as TR
from ..operators import typeahead as TA
from ..operators.broadcast import shuffled, sized_broadcast
from ..session import fresh_path, materialize
from ..sources import json_pages as JP
from ..sources import tables
from ..streaming import alarm as AL
from ..streaming import latest as PL
from ..streaming import pages as PS
from ..streaming import quota as QT
from . import fixtures as X
from ..sources import snapshot as SN
from .jobs import Snapshot, prepare_training, serve_recommendations, serve_similar, train_snapshot


def similar_top5(spark: SparkSession, sf: str) -> DataFrame:
    """M6 for every item: top 5 de-biased cosine neighbours with catalogue rows."""
    items, users = X.similarity_factors(spark, sf)
    direction = V.mean_direction(users, "features")
    units = S.projected_units(items, direction)
    sim = S.similar_items(units, 5)
    out = S.enrich_similar(sim, X.catalogue(spark, sf))
    return out.select("src_id", "src_title", "rank", "item_id", "title",
                      result_round("similarity").alias("similarity"),
                      result_round("average_rating").alias("average_rating"),
                      "num_ratings")


def ratings_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """P1 + A7: rated rows, one per (user, item), last write wins."""
    return X.canonical(spark, sf)


def popularity_filtered_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A1 + J1 + A3: the training set's size after the popularity filter.

    ``n_raw_rated`` counts rated rows of popular items before the dedupe (what
    the reference trains on); the other counts describe the canonical set.
    """
    # The joined view is written, as three aggregates read it.
    raw = materialize(tables.raw_ratings(spark, sf, with_order=True), "raw_ratings")
    popular = materialize(R.popular_items(raw.select("item_id"), X.MIN_RATINGS), "popular_items")
    train = materialize(R.training_ratings(raw, X.MIN_RATINGS, popular=popular), "training_ratings")
    popular_ids = sized_broadcast(popular.select("item_id"), row_bytes=16)
    raw_rated = R.rated_only(raw).join(popular_ids, "item_id", "left_semi")
    return R.dataset_counts(train).select(
        popular.agg(F.count(F.lit(1))).scalar().alias("n_popular_items"),
        raw_rated.agg(F.count(F.lit(1))).scalar().alias("n_raw_rated"),
        "n_ratings", "n_users", "n_items")


def item_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A6 + D2: the catalogue, every titled item with its rating statistics."""
    return X.catalogue(spark, sf).select(
        "item_id", "title", result_round("average_rating").alias("average_rating"), "num_ratings")


def _foldin_out(users: DataFrame) -> DataFrame:
    return users.select("user_key", "n",
                        result_round(F.col("features")[0]).alias("u0"),
                        result_round(F.col("features")[1]).alias("u1"))


def foldin_rank2(spark: SparkSession, sf: str) -> DataFrame:
    """M3 closed form at k = 2 over every user's canonical ratings; an item's two values
    are the sums of the halves of its embedding."""
    items = X.foldin_item_factors(spark, sf)
    return _foldin_out(FI.foldin(X.canonical(spark, sf), items, X.REGULARIZATION, 2, closed_form=True))


def _solved(canon: DataFrame, items: DataFrame, users: DataFrame, lam: float, k: int = X.FULL_RANK) -> DataFrame:
    """``(user_key, n, ok)``: whether ``users(user_key, n, u)`` solve their normal equations.

    The residual X^T (r - X u) - n lambda u is summed up in column functions,
    apart from the solver: a sum for each of the ``k`` values, so a user has one
    group, on the partitions of the join with ``users``.
    """
    rows = canon.join(V.narrowed(items, "features"), "item_id").join(shuffled(users), "user_key")
    error = F.col("rating") - V.dot("features", "u")
    part = rows.select("user_key", "n", "u", "features", error.alias("e"))
    sums = part.groupBy("user_key").agg(
        F.first("n").alias("n"), F.first("u").alias("u"),
        *[F.sum(F.get("features", F.lit(i)) * F.col("e")).alias(f"s{i}") for i in range(k)])
    left = [F.abs(F.col(f"s{i}") - F.col("n") * lam * F.get("u", F.lit(i))) for i in range(k)]
    return sums.select("user_key", "n", (F.greatest(*left) <= 1e-6 * (1 + F.col("n"))).alias("ok"))


def _folded_in(spark: SparkSession, sf: str, ratings: DataFrame, split_rows: int | None = None) -> DataFrame:
    items = X.foldin_item_factors(spark, sf, X.FULL_RANK)
    users = materialize(FI.foldin(ratings, items, X.REGULARIZATION, X.FULL_RANK, split_rows=split_rows)
                        .select("user_key", "n", F.col("features").alias("u")), "foldin_rank64")
    return _solved(ratings, items, users, X.REGULARIZATION)


def foldin_rank64(spark: SparkSession, sf: str) -> DataFrame:
    """M3 at k = 64: every user's fold-in, and whether it solves their normal equations.

    The SQL side gives the count and TRUE.
    """
    return _folded_in(spark, sf, X.canonical_written(spark, sf))


def foldin_pandas(spark: SparkSession, sf: str) -> DataFrame:
    """``foldin_rank64`` with the users of more than 48 ratings split and merged."""
    return _folded_in(spark, sf, X.canonical_written(spark, sf), split_rows=48)


def foldin_household(spark: SparkSession, sf: str) -> DataFrame:
    """M3 at k = 64 where one user owns a third of the ratings: every third user is
    of one household, whose last rating of an item counts."""
    raw = tables.raw_ratings(spark, sf, with_order=True, rated=True)
    member = F.when(F.col("user_key") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("user_key"))
    canon = materialize(R.canonical_ratings(raw.withColumn("user_key", member)), "household_ratings")
    return _folded_in(spark, sf, canon, split_rows=50)


def recommend_rank2_top10(spark: SparkSession, sf: str) -> DataFrame:
    """M5: fold-in -> score all items -> drop rated -> top 10 -> catalogue."""
    items = X.foldin_item_factors(spark, sf)
    canon = X.canonical_written(spark, sf)
    users = FI.foldin(canon, items, X.REGULARIZATION, 2)
    recs = RC.recommend(users, items, 10)
    out = RC.enrich_recommendations(recs, X.catalogue(spark, sf, canon))
    return out.select("user_key", "rank", "item_id", "title",
                      result_round("predicted_score").alias("predicted_score"),
                      result_round("average_rating").alias("average_rating"), "num_ratings")


def recommend_vectors_top10(spark: SparkSession, sf: str) -> DataFrame:
    """M4 + M5 on all 64 values: every odd embedding as a user against every embedding."""
    return _recommendations(spark, sf, 10).select(
        "user_key", "rank", "item_id", "title", result_round("predicted_score").alias("predicted_score"),
        result_round("average_rating").alias("average_rating"), "num_ratings")


def recommend_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    """P8 with a catalogue of one brand: items it lacks drop out, but a user of
    whose top 10 it has none keeps them all under placeholder titles."""
    recs = RC.recommend(X.vector_users(spark, sf, canon := X.canonical_written(spark, sf)),
                        X.foldin_item_factors(spark, sf, X.FULL_RANK), 10)
    brand = tables.table(spark, sf, "part").where(F.col("p_brand") == X.LISTED_BRAND)
    listed = R.catalogue(brand.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title")), canon)
    return RC.enrich_recommendations(recs, listed, "reference").select(
        "user_key", "rank", "item_id", "title", result_round("average_rating").alias("average_rating"), "num_ratings")


def foldin_refreshed(spark: SparkSession, sf: str) -> DataFrame:
    """S9 + Q17: all users are folded in once while every 64th still lacks the ratings of
    even items, and refreshed when they are there: the users of changed buckets anew, the
    others as stored.  Their number of ratings, whether they solve their normal equations,
    and whether they are those of a full run."""
    canon = X.canonical_written(spark, sf)
    items = materialize(X.foldin_item_factors(spark, sf, X.FULL_RANK), "refresh_items")
    root = fresh_path(spark, "refresh")
    late = (F.col("user_key") % 64 == 5) & (F.col("item_id") % 2 == 0)
    RF.refresh(canon.where(~late), items, X.REGULARIZATION, X.FULL_RANK, root)
    run = RF.refresh(canon, items, X.REGULARIZATION, X.FULL_RANK, root)
    users = materialize(RF.folded_users(spark, root, run).select("user_key", "n", F.col("features").alias("u")), "refreshed")
    full = FI.foldin(canon, items, X.REGULARIZATION, X.FULL_RANK).select("user_key", F.col("features").alias("v"))
    far = F.array_max(F.zip_with("u", "v", lambda a, b: F.abs(a - b)))
    same = users.join(full, "user_key", "full").select("user_key", (F.coalesce(far, F.lit(1.0)) <= 1e-9).alias("same"))
    return _solved(canon, items, users, X.REGULARIZATION).join(same, "user_key", "full")


def _search_out(res: DataFrame) -> DataFrame:
    return res.select(F.col("qid").alias("q"), "rank", "item_id", "title",
                      result_round("average_rating").alias("average_rating"), "num_ratings", "tier")


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue, written: the search reads it for the frequencies of its grams, its grams and its titles."""
    return materialize(X.catalogue(spark, sf), "catalogue")


def search_top10(spark: SparkSession, sf: str) -> DataFrame:
    """M7: the fixture's search texts against every title of the catalogue."""
    terms = spark.createDataFrame([(t, t) for t in X.SEARCH_TERMS], "qid string, q string")
    return _search_out(SE.search(terms, _listed(spark, sf), n=10))


def search_title_words(spark: SparkSession, sf: str) -> DataFrame:
    """M7 for a query table derived from the catalogue: every distinct title
    word, and its first three letters in upper case."""
    words = (tables.titles(spark, sf)
             .select(F.explode(F.split("title", " ")).alias("w"))
             .where(F.length("w") > 0))
    terms = (words.select(F.col("w").alias("q"))
             .union(words.select(F.upper(F.substring("w", 1, 3)).alias("q")))
             .distinct()
             .select(F.col("q").alias("qid"), "q"))
    return _search_out(SE.search(terms, _listed(spark, sf), n=10))


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    words = (tables.titles(spark, sf).select(F.explode(F.split("title", " ")).alias("w"))
             .where(F.length("w") > 0).distinct())
    return (words.select(F.explode(F.array(*[F.substring("w", 1, i) for i in (1, 2, 3)])).alias("q"))
            .distinct().select(F.col("q").alias("qid"), "q"))


def search_as_typed(spark: SparkSession, sf: str) -> DataFrame:
    """M7 while a title word is typed: its first one, two and three letters, of
    which a client sends those of at least two characters."""
    return _search_out(SE.search(_typed(spark, sf), _listed(spark, sf), n=10, min_len=SEARCH_MIN_CHARS_CLIENT))


def search_typed_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """``search_as_typed`` through a stored prefix table; the gram search takes what it can't answer."""
    listed = _listed(spark, sf)
    prefixes = materialize(TA.prefix_table(listed, 10), "prefix_table")
    return _search_out(TA.search_typed(_typed(spark, sf), listed, prefixes, 10, SEARCH_MIN_CHARS_CLIENT))


def recommend_leave_last_out(spark: SparkSession, sf: str) -> DataFrame:
    """M9: every user's last rated item is left out, the rest folded in (closed form), and the
    top 10 are looked through for it: hit rate, precision, MRR and NDCG."""
    train, held = EV.leave_last_out(tables.raw_ratings(spark, sf, with_order=True, rated=True))
    train, held = materialize(train, "evaluation_ratings"), materialize(held, "evaluation_held_out")
    items = X.foldin_item_factors(spark, sf)
    recs = materialize(RC.recommend(FI.foldin(train, items, X.REGULARIZATION, X.FOLDIN_RANK), items, 10), "evaluation_top")
    return EV.ranking_metrics(recs, held, 10).select(
        "users", "hits", *[result_round(c).alias(c) for c in ("hit_rate", "precision", "mrr", "ndcg")])


def similar_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Similar-item requests derived from the event log (one per event):
    clicks carry the item of ``props.k``, purchases the same text padded with
    blanks, views their value as text (not an integer), errors the raw props or
    (even events) a number of more than 20 digits, sign-ups no item at all."""
    ev = tables.table(spark, sf, "events").select("event_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k")
    text = (F.when(F.col("event_type") == "click", k)
            .when(F.col("event_type") == "purchase", F.concat(F.lit(" "), k, F.lit(" ")))
            .when(F.col("event_type") == "view", F.col("value").cast("string"))
            .when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0),
                  F.concat(F.lit("9" * 20), k))
            .when(F.col("event_type") == "error", F.col("props")))
    return ev.select(F.col("event_id").alias("request_id"), text.alias("item_text"))


def similar_request_status(spark: SparkSession, sf: str) -> DataFrame:
    """P4 + P5 for a batch of similar-item requests."""
    items, _ = X.similarity_factors(spark, sf)
    out = RQ.validate_similar(similar_requests(spark, sf),
                              items.select(F.col("id").alias("item_id")),
                              tables.titles(spark, sf))
    return out.select("request_id", "item_id", "status")


def recommend_request_status(spark: SparkSession, sf: str) -> DataFrame:
    """P5 for a recommendation request from every customer."""
    reqs = tables.customers(spark, sf).select(F.col("user_key").alias("request_id"), "user_key")
    model_items = X.foldin_item_factors(spark, sf).select("item_id")
    return RQ.validate_recommend(reqs, X.canonical(spark, sf), model_items)


def request_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """P5: the rejected requests of both kinds with their reason (accepted ones
    go on to the answering jobs)."""
    sim = similar_request_status(spark, sf).select(
        F.lit("similar").alias("kind"), "request_id", F.col("status").alias("reason"))
    rec = recommend_request_status(spark, sf).select(
        F.lit("recommend").alias("kind"), "request_id", F.col("status").alias("reason"))
    return sim.unionByName(rec).where(F.col("reason") != "ok")


def _recommendations(spark: SparkSession, sf: str, n: int) -> DataFrame:
    canon = X.canonical_written(spark, sf)
    recs = RC.recommend(X.vector_users(spark, sf, canon), X.foldin_item_factors(spark, sf, X.FULL_RANK), n)
    return RC.enrich_recommendations(recs, X.catalogue(spark, sf, canon))


def report_pages(spark: SparkSession, sf: str) -> DataFrame:
    """P8-P11 + A9: the top 100 per user (the API's n) as 20-row report pages."""
    return RP.recommendation_report(_recommendations(spark, sf, RECOMMEND_N_API), X.ITEM_BASE_URL)


def result_envelope_counts(spark: SparkSession, sf: str) -> DataFrame:
    """One envelope per user; its JSON text, count, first and last entries."""
    env = RP.envelope(_recommendations(spark, sf, 10), "user_key", ["item_id", "title"], "recommendations")
    recs = F.col("recommendations")
    return env.select("user_key", "total_items",
                      recs[0]["item_id"].alias("first_item_id"),
                      F.element_at(recs, -1)["item_id"].alias("last_item_id"),
                      "json")


def _land(spark: SparkSession, sf: str) -> str:
    path = fresh_path(spark, "list_pages")
    raw = tables.raw_ratings(spark, sf, with_order=True)
    return JP.land_pages(raw, path, spread_cols=("seq",))


def _landed_pages(spark: SparkSession, sf: str) -> DataFrame:
    return JP.read_pages(spark, _land(spark, sf))


def list_pages_stream(spark: SparkSession, sf: str) -> DataFrame:
    """S3 in Structured Streaming: landed pages ingested by a file stream into a
    parquet sink (available-now trigger), read back from the sink."""
    landing = _land(spark, sf)
    base = fresh_path(spark, "list_pages_stream")
    q = PS.run_ingest(spark, landing, f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def list_pages_exploded(spark: SparkSession, sf: str) -> DataFrame:
    """S3: land every user's list as JSON pages, ingest them back."""
    return JP.ingest(_landed_pages(spark, sf))


def list_pages_summary(spark: SparkSession, sf: str) -> DataFrame:
    """S3 + Q20: pages, entries and rated entries per user; list complete."""
    return JP.page_summary(_landed_pages(spark, sf))


def list_pages_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Q20 with pages of 20 entries, the second page of every seventh user lost."""
    raw = tables.raw_ratings(spark, sf, with_order=True)
    pages = JP.read_pages(spark, JP.land_pages(raw, fresh_path(spark, "list_pages"), 20, spread_cols=("seq",)))
    lost = (F.col("user_key").cast("long") % 7 == 0) & (F.col("page") == 1)
    return JP.page_summary(pages.where(~lost)).select("user_key", "pages", "complete")


def quota_daily(spark: SparkSession, sf: str) -> DataFrame:
    """T1 in batch: calls per client, endpoint and day over the quota."""
    return QT.over_quota(tables.request_log(spark, sf), X.QUOTA_WINDOW, X.QUOTA_LIMIT)


def quota_hourly_by_endpoint(spark: SparkSession, sf: str) -> DataFrame:
    """T1 with a quota per endpoint (as the reference limits each route):
    hourly windows; sign-ups may come twice an hour, the rest once."""
    log = tables.request_log(spark, sf)
    quotas = materialize(
        log.select("endpoint").distinct()
        .select("endpoint", F.when(F.col("endpoint") == "signup", 2).otherwise(1)
                .cast("long").alias("quota")), "quotas")
    return QT.over_quota(log, "1 hour", quotas)


def quota_daily_stream(spark: SparkSession, sf: str) -> DataFrame:
    """T1 in Structured Streaming over the event log, available-now trigger."""
    schema = tables.table(spark, sf, "events").schema
    source = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .parquet(sf)
              .select(F.col("ts").cast("timestamp").alias("ts"),
                      F.col("user_id").alias("client"), F.col("event_type").alias("endpoint")))
    base = fresh_path(spark, "quota_stream")
    q = QT.run_stream(spark, source, f"{base}/out", f"{base}/checkpoint", X.QUOTA_WINDOW)
    q.awaitTermination()
    return QT.read_stream_result(spark, f"{base}/out", X.QUOTA_LIMIT)


def quota_hourly_routes(spark: SparkSession, sf: str) -> DataFrame:
    """T1 with the service's own quotas: every hour of every client and route.

    Views ask for recommendations, clicks for similar items, the rest search.
    """
    route = (F.when(F.col("endpoint") == "view", "recommendations")
             .when(F.col("endpoint") == "click", "similar").otherwise("search"))
    return QT.audit(tables.request_log(spark, sf).withColumn("endpoint", route), "1 hour", QT.route_quotas(spark))


def quota_daily_stream_runs(spark: SparkSession, sf: str) -> DataFrame:
    """T1 in Structured Streaming over a log that lands in four parts, in order of
    time; the stream is started on its checkpoint after each of them."""
    log = tables.request_log(spark, sf)
    base = fresh_path(spark, "quota_runs")
    cuts = log.agg(F.percentile_approx(F.unix_micros("ts"), [0.25, 0.5, 0.75])).first()[0] or [0, 0, 0]
    part = sum((F.when(F.unix_micros("ts") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    for i in range(len(cuts) + 1):
        log.where(part == i).write.mode("append").parquet(f"{base}/log")
        source = spark.readStream.schema(log.schema).parquet(f"{base}/log")
        QT.run_stream(spark, source, f"{base}/out", f"{base}/checkpoint", X.QUOTA_WINDOW).awaitTermination()
    return QT.read_stream_result(spark, f"{base}/out", X.QUOTA_LIMIT)


def _in_parts(log: DataFrame, path: str, run, parts: int = 4) -> None:
    """Lands ``log`` in parts that have nothing to do with its order, ``run()`` after each."""
    part = F.pmod(F.xxhash64(*log.columns), F.lit(parts))
    for i in range(parts):
        log.where(part == i).write.mode("append").parquet(path)
        run().awaitTermination()


def quota_late_stream(spark: SparkSession, sf: str) -> DataFrame:
    """T1 in Structured Streaming over a log that lands out of order: the calls that the
    stream counted, those behind the watermark, and both together (the log's)."""
    log = tables.request_log(spark, sf)
    base = fresh_path(spark, "quota_late")
    _in_parts(log, f"{base}/log", lambda: QT.run_stream(
        spark, spark.readStream.schema(log.schema).parquet(f"{base}/log"), f"{base}/out", f"{base}/checkpoint",
        X.QUOTA_WINDOW))
    counted = spark.read.parquet(f"{base}/out").groupBy(*QT.KEYS).agg(F.max("calls").alias("calls"))
    late = QT.uncounted(log, f"{base}/out", X.QUOTA_WINDOW).select(*QT.KEYS, F.col("late").alias("calls"))
    return (counted.unionByName(late).groupBy("client", "endpoint", "window_start")
            .agg(F.sum("calls").alias("calls")))


def quota_alarm_stream(spark: SparkSession, sf: str) -> DataFrame:
    """T1 with an alarm at a window's first breach, over a log that lands out of order in
    four parts, the stream started on its checkpoint after each: calls (counted and late),
    and whether there is one alarm where the counted ones are above the quota, else none."""
    log = tables.request_log(spark, sf)
    base = fresh_path(spark, "quota_alarms")
    _in_parts(log, f"{base}/log", lambda: AL.run_alarms(
        spark, spark.readStream.schema(log.schema).parquet(f"{base}/log"), f"{base}/out", f"{base}/checkpoint",
        X.QUOTA_WINDOW, X.QUOTA_LIMIT))
    rows = AL.read_alarms(spark, f"{base}/out")
    breached = F.col("counted") > F.col("quota")
    return rows.select("client", "endpoint", "window_start", (F.col("counted") + F.col("late")).alias("calls"),
                       ((F.col("alarms") == breached.cast("long"))
                        & (F.col("breached_at").isNotNull() == breached)
                        & F.coalesce(F.col("breached_at").between(F.col("window_start"), F.col("window_end")),
                                     F.lit(True))).alias("alarm_ok"))


def ratings_latest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A7 + S3 as a stream: every user's list lands as pages of 20 entries, out of order, in
    three parts; keyed state keeps the last write of each pair, restarted after each part."""
    raw = tables.raw_ratings(spark, sf, with_order=True)
    pages = JP.read_pages(spark, JP.land_pages(raw, fresh_path(spark, "list_pages"), 20, spread_cols=("seq",)))
    base = fresh_path(spark, "latest_stream")
    part = F.pmod(F.xxhash64("user_key", "page"), F.lit(3))
    for i in range(3):
        pages.where(part == i).write.json(f"{base}/landed/{i}")
        PL.run_latest(spark, f"{base}/landed", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return PL.read_latest(spark, f"{base}/out").withColumn("user_key", F.col("user_key").cast("long"))


def dense_index_users(spark: SparkSession, sf: str) -> DataFrame:
    """A2: every rating user -> dense index in key order."""
    return R.dense_index(X.canonical(spark, sf), "user_key", "user")


def dense_index_extended(spark: SparkSession, sf: str) -> DataFrame:
    """A2 over two snapshots: users of the odd items are numbered first, all others behind them."""
    canon = X.canonical_written(spark, sf)
    first = materialize(R.dense_index(canon.where(F.col("item_id") % 2 == 1), "user_key", "user"), "user_index")
    return R.extend_index(first, canon, "user_key", "user")


def item_stats_merged(spark: SparkSession, sf: str) -> DataFrame:
    """A1 + A3 + A6 from a partial table for each of four batches of users, merged on read;
    whether the sketch of an item's users is within its error."""
    canon = X.canonical_written(spark, sf)
    folder = fresh_path(spark, "item_partials")
    for i in range(4):
        PT.append_batch(canon.where(F.col("user_key") % 4 == i), folder, str(i))
    return PT.merged_stats(spark, folder).select(
        "item_id", result_round("average_rating").alias("average_rating"), "num_ratings",
        (F.abs(F.col("distinct_users") - F.col("num_ratings")) <= 1 + 0.08 * F.col("num_ratings")).alias("users_ok"))


def _trained(spark: SparkSession, sf: str) -> Snapshot:
    """A model of the given tables, trained here and now."""
    root = fresh_path(spark, "models")
    raw = tables.raw_ratings(spark, sf, with_order=True)
    return Snapshot(spark, root, train_snapshot(spark, raw, root, X.ALS_PARAMS, force=True))


def training_triples_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S4 + S5 + S6: index tables and training triples written into a run
    folder and read back (the preparation half of training, no fit)."""
    root = fresh_path(spark, "models")
    run = SN.new_run_id()
    raw = tables.raw_ratings(spark, sf, with_order=True)
    prepare_training(spark, raw, root, run, X.ALS_PARAMS.min_ratings)
    return SN.read_table(spark, root, run, "triples")


def als_stationary(spark: SparkSession, sf: str) -> DataFrame:
    """M1-M3 property: folding every training user back in over the trained
    item factors reproduces their ALS user factor (``ok``), with ``n`` the
    user's training ratings.  The SQL side gives the count and TRUE."""
    snap = _trained(spark, sf)
    k = X.ALS_PARAMS.factors
    triples = snap.table("triples").select(
        F.col("user").alias("user_key"), F.col("item").alias("item_id"), "rating")
    items = snap.table("item_factors").select(
        F.col("id").alias("item_id"), F.col("features").cast("array<double>").alias("features"))
    folded = FI.foldin(triples, items, X.ALS_PARAMS.regularization, k, closed_form=False)
    users = snap.table("user_factors").select(
        F.col("id").alias("user_key"), F.col("features").cast("array<double>").alias("trained"))
    diff = F.array_max(F.zip_with("features", "trained", lambda a, b: F.abs(a - b)))
    size = F.array_max(F.transform("trained", lambda x: F.abs(x)))
    checked = folded.join(users, "user_key").select(
        "user_key", "n", (diff <= F.lit(1e-4) * (1 + size)).alias("ok"))
    index = snap.table("user_index")
    return (checked.join(shuffled(index), checked.user_key == index.user)
            .select(index.user_key, "n", "ok"))


def als_model_checks(spark: SparkSession, sf: str) -> DataFrame:
    """M8 on a trained snapshot: item index against item factors."""
    snap = _trained(spark, sf)
    return TR.model_checks(snap.table("item_index"), snap.table("item_factors"),
                           X.ALS_PARAMS.factors)


def model_checks_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """M8 on the fixture model: catalogue items against the embedding vectors."""
    index = tables.titles(spark, sf).select(F.col("item_id").alias("item"))
    return TR.model_checks(index, tables.embedding_vectors(spark, sf), 64)


def _recommend_facts(recs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Per user: rows, ranks 1..n in score order, no rated item, scores equal to the dot product."""
    # The users with their rated items come last: they are the widest, and the groups are theirs.
    joined = (recs.join(items.select("item_id", "features"), "item_id")
              .join(users.select("user_key", F.col("features").alias("u"), "rated"), "user_key"))
    fresh = ~F.array_contains("rated", F.col("item_id"))
    exact = F.abs(V.dot("u", "features") - F.col("predicted_score")) <= 1e-9 * (1 + F.abs("predicted_score"))
    last = F.lag("predicted_score").over(Window.partitionBy("user_key").orderBy("rank"))
    rows = joined.select("user_key", "rank", fresh.alias("fresh"), exact.alias("exact"),
                         F.coalesce(last >= F.col("predicted_score"), F.lit(True)).alias("down"))
    return rows.groupBy("user_key").agg(
        F.count(F.lit(1)).alias("n_rows"),
        ((F.max("rank") == F.count(F.lit(1))) & (F.countDistinct("rank") == F.count(F.lit(1)))
         & F.min("down")).alias("ranks_ok"),
        F.min("fresh").alias("none_rated"), F.min("exact").alias("scores_ok"))


def als_recommend_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The trained recommend flow, checked: facts per user that SQL states on its own."""
    items = _trained(spark, sf).item_vectors()
    users = materialize(FI.foldin(X.canonical_written(spark, sf), items, X.ALS_PARAMS.regularization,
                                  X.ALS_PARAMS.factors), "als_users")
    return _recommend_facts(RC.recommend(users, items, 10), users, V.narrowed(items, "features"))


def _similar_facts(sim: DataFrame, units: DataFrame) -> DataFrame:
    """Per source: rows, ranks 1..n in order, not itself, cosines equal to the dot product."""
    joined = (sim.join(units.select(F.col("id").alias("item_id"), F.col("unit").alias("v")), "item_id")
              .join(units.select(F.col("id").alias("src_id"), F.col("unit").alias("u")), "src_id"))
    exact = (F.abs(V.dot("u", "v") - F.col("similarity")) <= 1e-9) & (F.abs("similarity") <= 1 + 1e-9)
    last = F.lag("similarity").over(Window.partitionBy("src_id").orderBy("rank"))
    rows = joined.select("src_id", "rank", (F.col("src_id") != F.col("item_id")).alias("other"), exact.alias("exact"),
                         F.coalesce(last >= F.col("similarity"), F.lit(True)).alias("down"))
    return rows.groupBy("src_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        ((F.max("rank") == F.count(F.lit(1))) & (F.countDistinct("rank") == F.count(F.lit(1)))
         & F.min("down")).alias("ranks_ok"),
        F.min("other").alias("no_self"), F.min("exact").alias("scores_ok"))


def als_similar_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The trained similar flow, checked: facts per item that SQL states on its own."""
    units = materialize(_trained(spark, sf).item_units(), "als_units")
    return _similar_facts(S.similar_items(units, 10), units)


def similar_blocks_top5(spark: SparkSession, sf: str) -> DataFrame:
    """M6 by the block form of the scorer, which larger models take: same answer as ``similar_top5``."""
    items, users = X.similarity_factors(spark, sf)
    units = S.projected_units(items, V.mean_direction(users, "features"))
    sim = S.similar_items(units, 5, broadcast_bytes=0, block_bytes=32 * 1024)
    return S.enrich_similar(sim, X.catalogue(spark, sf)).select(
        "src_id", "src_title", "rank", "item_id", "title", result_round("similarity").alias("similarity"),
        result_round("average_rating").alias("average_rating"), "num_ratings")


def als_recommend_top10(spark: SparkSession, sf: str) -> DataFrame:
    """The whole flow: train ALS into a snapshot, fold every user in over the
    trained item factors, top 10 unrated items per user, catalogue rows."""
    snap = _trained(spark, sf)
    items = snap.item_vectors()
    canon = X.canonical_written(spark, sf)
    users = FI.foldin(canon, items, X.ALS_PARAMS.regularization, X.ALS_PARAMS.factors)
    recs = RC.enrich_recommendations(RC.recommend(users, items, 10), X.catalogue(spark, sf, canon))
    return recs.select("user_key", "rank", "item_id", "title",
                       result_round("predicted_score").alias("predicted_score"),
                       result_round("average_rating").alias("average_rating"), "num_ratings")


def als_similar_top10(spark: SparkSession, sf: str) -> DataFrame:
    """M6 over a trained model: the projected unit vectors are computed once at
    training time and stored in the snapshot; top 10 per item, catalogue rows."""
    snap = _trained(spark, sf)
    sim = S.enrich_similar(S.similar_items(snap.item_units(), 10), X.catalogue(spark, sf))
    return sim.select("src_id", "src_title", "rank", "item_id", "title",
                      result_round("similarity").alias("similarity"),
                      result_round("average_rating").alias("average_rating"), "num_ratings")


def similar_report(spark: SparkSession, sf: str) -> DataFrame:
    """M6 + P10: the top 20 per item (the API's n) as report text."""
    items, users = X.similarity_factors(spark, sf)
    units = S.projected_units(items, V.mean_direction(users, "features"))
    sim = S.enrich_similar(S.similar_items(units, SIMILAR_N_API), X.catalogue(spark, sf))
    return RP.similar_report(sim, X.ITEM_BASE_URL)


def recommend_requests_served(spark: SparkSession, sf: str) -> DataFrame:
    """P5 + M5 + S10 for a request from every customer: status, and for the accepted ones the
    top 10 of the rank 2 model as an envelope (count, first and last item); on all 64 values whether the answer holds: the user's vector solves their normal
    equations, the count is that of the entries, scores fall, none is rated, and every
    score is the dot product of the two vectors."""
    reqs = tables.customers(spark, sf).select(F.col("user_key").alias("request_id"), "user_key")
    canon = X.canonical_written(spark, sf)
    items = materialize(X.foldin_item_factors(spark, sf, X.FULL_RANK), "served_items")
    listed = materialize(X.catalogue(spark, sf, canon), "catalogue")
    recs = F.col("recommendations")
    plain = (serve_recommendations(reqs, canon, X.foldin_item_factors(spark, sf), listed, 10,
                                   X.REGULARIZATION, X.FOLDIN_RANK).where("status = 'ok'")
             .select("user_key", F.col("total_items").alias("plain_items"), recs[0]["item_id"].alias("first_item_id"),
                     F.element_at(recs, -1)["item_id"].alias("last_item_id")).dropDuplicates(["user_key"]))
    out = materialize(serve_recommendations(reqs, canon, items, listed, 10, X.REGULARIZATION, X.FULL_RANK), "served")
    users = materialize(FI.foldin(canon, items, X.REGULARIZATION, X.FULL_RANK)
                        .select("user_key", "n", F.col("features").alias("u"), "rated"), "served_users")
    solved = _solved(canon, items, users.drop("rated"), X.REGULARIZATION).select(
        "user_key", F.col("n").alias("n_known"), F.col("ok").alias("solved"))
    entries = (out.where("status = 'ok'").select("user_key", F.posexplode("recommendations").alias("at", "r"))
               .select("user_key", "at", "r.item_id", "r.predicted_score")
               .join(items, "item_id").join(users, "user_key"))
    before = F.lag("predicted_score").over(Window.partitionBy("user_key").orderBy("at"))
    exact = F.abs(V.dot("u", "features") - F.col("predicted_score")) <= 1e-9 * (1 + F.abs("predicted_score"))
    facts = (entries.select("user_key", exact.alias("exact"), F.array_contains("rated", F.col("item_id")).alias("old"),
                            F.coalesce(before >= F.col("predicted_score"), F.lit(True)).alias("falls"))
             .groupBy("user_key").agg(F.count(F.lit(1)).alias("entries"), F.min("falls").alias("ordered"),
                                      (~F.max("old")).alias("none_rated"), F.min("exact").alias("scores_ok")))
    ok = F.col("status") == "ok"
    return (out.join(shuffled(plain), "user_key", "left").join(shuffled(solved), "user_key", "left")
            .join(shuffled(facts), "user_key", "left")
            .select("request_id", "status",
                    F.coalesce("plain_items", F.lit(0).cast("long")).alias("total_items"),
                    "first_item_id", "last_item_id", F.when(ok, F.col("n_known")).alias("n_known"),
                    F.when(ok, F.col("solved")).alias("solved"),
                    F.when(ok, F.col("total_items") == F.coalesce("entries", F.lit(0))).alias("counted"),
                    *[F.when(ok, F.coalesce(c, F.lit(True))).alias(c) for c in ("ordered", "none_rated", "scores_ok")]))


def similar_requests_served(spark: SparkSession, sf: str) -> DataFrame:
    """P4 + P5 + M6 + J10 + S10 for every event's similar-item request: status,
    source title and ratings, and the top 20 as an envelope (count, first item, best score)."""
    items, users = X.similarity_factors(spark, sf)
    units = S.projected_units(items, V.mean_direction(users, "features"))
    out = serve_similar(similar_requests(spark, sf), units, X.catalogue(spark, sf), SIMILAR_N_API)
    sim = F.col("similar")
    return out.select("request_id", "item_id", "status", "src_title",
                      result_round("src_average_rating").alias("src_average_rating"), "src_num_ratings", "total_items",
                      sim[0]["item_id"].alias("first_item_id"),
                      result_round(sim[0]["similarity"]).alias("best_similarity"))


QUERIES = {
    "ratings_canonical": ratings_canonical,
    "popularity_filtered_counts": popularity_filtered_counts,
    "item_stats": item_stats,
    "foldin_rank2": foldin_rank2,
    "foldin_pandas": foldin_pandas,
    "foldin_household": foldin_household,
    "recommend_rank2_top10": recommend_rank2_top10,
    "recommend_vectors_top10": recommend_vectors_top10,
    "recommend_placeholders": recommend_placeholders,
    "foldin_rank64": foldin_rank64,
    "similar_blocks_top5": similar_blocks_top5,
    "als_recommend_checks": als_recommend_checks,
    "als_similar_checks": als_similar_checks,
    "similar_top5": similar_top5,
    "similar_report": similar_report,
    "search_top10": search_top10,
    "search_title_words": search_title_words,
    "search_as_typed": search_as_typed,
    "search_typed_prefixes": search_typed_prefixes,
    "recommend_leave_last_out": recommend_leave_last_out,
    "similar_request_status": similar_request_status,
    "recommend_request_status": recommend_request_status,
    "request_rejects": request_rejects,
    "report_pages": report_pages,
    "result_envelope_counts": result_envelope_counts,
    "recommend_requests_served": recommend_requests_served,
    "similar_requests_served": similar_requests_served,
    "list_pages_exploded": list_pages_exploded,
    "list_pages_summary": list_pages_summary,
    "list_pages_stream": list_pages_stream,
    "list_pages_gap": list_pages_gap,
    "quota_daily": quota_daily,
    "quota_daily_stream": quota_daily_stream,
    "quota_daily_stream_runs": quota_daily_stream_runs,
    "quota_late_stream": quota_late_stream,
    "quota_alarm_stream": quota_alarm_stream,
    "ratings_latest_stream": ratings_latest_stream,
    "quota_hourly_by_endpoint": quota_hourly_by_endpoint,
    "quota_hourly_routes": quota_hourly_routes,
    "dense_index_users": dense_index_users,
    "dense_index_extended": dense_index_extended,
    "item_stats_merged": item_stats_merged,
    "foldin_refreshed": foldin_refreshed,
    "training_triples_roundtrip": training_triples_roundtrip,
    "als_stationary": als_stationary,
    "als_model_checks": als_model_checks,
    "model_checks_embeddings": model_checks_embeddings,
    "als_recommend_top10": als_recommend_top10,
    "als_similar_top10": als_similar_top10,
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return als_recommend_top10(spark, sf)

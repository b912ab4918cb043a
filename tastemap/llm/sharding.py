"""Balanced label propagation: linked documents move to their neighbours' shards.

Documents of one group (equal texts) are linked to each other.  Every shard
has a row quota, ``floor`` or ``ceil`` of rows / shards.

The members of a group have the same neighbours, so a round moves *counts* of
a group between shards, at most one row per (group, shard), whatever the
group's size.  A round:

1. Every group names the shard that holds most of its members (one with room
   and, where none has any, the roomiest); members elsewhere want to move
   there and gain ``members there - members here`` neighbours.
2. Those that want to move leave, which sets the room of every shard.
3. Movers are accepted in order of gain until a shard is full.  The order is
   a histogram of (shard, gain class, hash class), the only thing that reaches
   the driver; the class on the edge is accepted in proportion, rounded down.
   The others wait without a shard and take part in the next round.

The first round starts from an even dealing by position.  After the last one
the waiting members and the documents without links fill the quotas up to the
row, in an order that keeps a group's members together.  Row counts are thus
at most one apart, always.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import with_positions

ROUNDS = 4
HASH_CLASSES = 64
#: Members of a group that meet one row of the group's plan.
PART = 128


def _accepted(cells: list, room: list[int]) -> dict[tuple[int, int, int], float]:
    """Share of each (shard, gain class, hash class) that fits, best gains first."""
    left, share = list(room), {}
    for shard, gain, h, n in sorted(cells, key=lambda c: (c[0], -c[1], c[2])):
        take = min(n, left[shard])
        share[shard, gain, h] = take / n
        left[shard] -= take
    return share


def _propagate(state: DataFrame, quota: list[int], rounds: int) -> DataFrame:
    """``state(g, shard, n)`` after the rounds; a waiting row has shard -1."""
    spark = state.sparkSession
    room_type = "shard int, gain int, h int, share double"
    for r in range(rounds):
        held = {x["shard"]: x["n"] for x in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [q - held.get(s, 0) for s, q in enumerate(quota)]
        roomiest = max(range(len(quota)), key=lambda s: (room[s], -s))
        open_shards = F.array(*[F.lit(x > 0) for x in room])
        # A group's best shard: most members; ties by a hash of both; a full one only if all are there.
        placed = F.col("shard") >= 0
        rank = F.struct(F.col("n"), F.xxhash64("g", "shard").alias("h"), F.col("shard"))
        best = state.groupBy("g").agg(
            F.max(F.when(placed & open_shards[F.greatest("shard", F.lit(0))], rank)).alias("open"),
            F.max(F.when(placed, rank)).alias("any"), F.sum("n").alias("all"))
        best = best.select("g", F.when(F.col("any.n") == F.col("all"), F.col("any.shard"))
                           .otherwise(F.coalesce("open.shard", F.lit(roomiest))).alias("to"))
        # A full shard that holds more of the group keeps its members.
        joined = state.join(best, "g").join(
            state.select("g", F.col("shard").alias("to"), F.col("n").alias("there")),
            ["g", "to"], "left").fillna(0, ["there"])
        gain = F.col("there") - F.when(placed, F.col("n")).otherwise(0)
        moves = (F.col("shard") != F.col("to")) & (~placed | (gain >= 0))
        plan = materialize(joined.select(
            "g", "shard", "to", "n", moves.alias("moves"),
            F.floor(F.log2(F.greatest(gain, F.lit(0)) + 1)).cast("int").alias("gain"),
            F.pmod(F.xxhash64("g", "shard", F.lit(r)), F.lit(HASH_CLASSES)).cast("int").alias("h")),
            "shard_moves")
        stay = {x["shard"]: x["n"] for x in plan.where("not moves").groupBy("shard")
                .agg(F.sum("n").alias("n")).collect()}
        cells = (plan.where("moves").groupBy("to", "gain", "h").agg(F.sum("n").alias("n")).collect())
        if not cells:
            break
        share = _accepted([tuple(c) for c in cells],
                          [q - stay.get(s, 0) for s, q in enumerate(quota)])
        # At most shards x gain classes x hash classes rows.
        shares = spark.createDataFrame([(*k, v) for k, v in share.items()], room_type)
        moving = (plan.where("moves").join(
            F.broadcast(shares.withColumnRenamed("shard", "to")), ["to", "gain", "h"])
            .withColumn("taken", F.floor(F.col("n") * F.col("share")).cast("long")))
        state = materialize(
            plan.where("not moves").select("g", "shard", "n")
            .union(moving.select("g", F.col("to").alias("shard"), F.col("taken").alias("n")))
            .union(moving.select("g", F.lit(-1).alias("shard"), F.col("n") - F.col("taken")))
            .where("n > 0").groupBy("g", "shard").agg(F.sum("n").alias("n")), "shard_state")
    return state


def assign(docs: DataFrame, shards: int, rounds: int = ROUNDS, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, shard, slot, group``.

    size is the UTF-8 bytes of the text plus 8; a null text has no bytes and
    checksum 0, and null texts are linked to each other (and not to empty
    ones).  Repeated rows are members of one group, each with its own place.
    An empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    body = F.col(text).cast("string")
    narrow = docs.select(
        F.col(key).alias("doc_id"), (F.coalesce(F.octet_length(body), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(body, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(F.encode(body, "UTF-8")), F.lit("null")).alias("g"))
    # position: over everything, in group order; member: within the group.
    own = with_positions(narrow, [F.col("g"), F.col("doc_id")], "shard_rows", group="g",
                         position="member")
    total = materialize(own, "shard_members")
    groups = total.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = total.count()
    quota = [rows // shards + (s < rows % shards) for s in range(shards)]

    # Even start: a group of n takes n consecutive shards, from a hashed one.
    def deal(n):
        first = F.pmod(F.xxhash64("g"), F.lit(shards)).cast("int")
        return F.explode(F.transform(
            F.sequence(F.lit(0), F.least(n, F.lit(shards).cast("long")).cast("int") - 1),
            lambda i: F.struct(
                F.pmod(first + i, F.lit(shards)).alias("shard"),
                (F.floor(n / shards) + F.when(i < n % shards, 1).otherwise(0)).cast("long").alias("n"))))

    start = groups.select("g", deal(F.col("n")).alias("d")).select("g", "d.shard", "d.n")
    start = _within(materialize(start, "shard_state"), quota)
    state = _propagate(start, quota, rounds)

    # Members of a group take its shards in order; the waiting ones come last.
    ranges = (state.groupBy("g").agg(F.sort_array(F.collect_list(F.struct(
        (F.col("shard") < 0).alias("w"), "shard", "n"))).alias("s"), F.sum("n").alias("all")))
    parts = ranges.select("g", "s", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("all") - 1) / PART))).alias("part"))

    def shard_of(member, s):
        found = F.aggregate(s, F.struct(member.alias("left"), F.lit(-2).alias("shard")), lambda acc, x: F.struct(
            (acc["left"] - x["n"]).alias("left"),
            F.when((acc["shard"] == -2) & (acc["left"] < x["n"]), x["shard"]).otherwise(acc["shard"]).alias("shard")))
        return found["shard"]

    placed = total.withColumn("part", F.floor(F.col("member") / PART)).join(parts, ["g", "part"], "left")
    placed = materialize(placed.select(
        "doc_id", "size", "text_crc32", "g",
        F.when(F.col("s").isNull(), -1).otherwise(shard_of(F.col("member"), F.col("s"))).alias("shard")),
        "shard_placed")

    held = {x["shard"]: x["count"] for x in placed.groupBy("shard").count().collect()}
    free = with_positions(placed.where("shard < 0"), [F.col("g"), F.col("doc_id")], "shard_free")
    edges, upto = [], 0
    for s, q in enumerate(quota):
        upto += q - held.get(s, 0)
        edges.append(upto)
    fill = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in edges]),
                           lambda e: e <= F.col("position")))
    done = (placed.where("shard >= 0").select("doc_id", "size", "text_crc32", "g", "shard")
            .union(free.select("doc_id", "size", "text_crc32", "g", fill.alias("shard"))))
    return with_positions(done.withColumn("shard", F.col("shard").cast("int")),
                          [F.col("shard"), F.col("g"), F.col("doc_id")], "shard_slots",
                          group="shard", position="slot")


def _within(state: DataFrame, quota: list[int]) -> DataFrame:
    """``state`` with the counts above a shard's quota set to wait."""
    held = {x["shard"]: x["n"] for x in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    keep = [min(1.0, q / held[s]) if held.get(s) else 1.0 for s, q in enumerate(quota)]
    if min(keep, default=1.0) == 1.0:
        return state
    kept = F.floor(F.col("n") * F.array(*[F.lit(k) for k in keep])[F.col("shard")]).cast("long")
    return materialize(state.select("g", "shard", kept.alias("n"))
                       .union(state.select("g", F.lit(-1), F.col("n") - kept)).where("n > 0")
                       .groupBy("g", "shard").agg(F.sum("n").alias("n")), "shard_state")

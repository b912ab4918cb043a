"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprint: 64 bits over the word shingles of a text; bit b is set if it is
set in over half of the shingles' XXH64 values (seed 42).  Documents whose
fingerprints differ in at most ``distance`` bits are linked, and every
connected component is a class.

Search, exact at every size:

1. Equal fingerprints are one node, so exact copies cost nothing.
2. The 64 bits are cut into ``distance + 2`` blocks.  Two fingerprints within
   the distance agree on at least two blocks, so a group per (pair of blocks,
   their values) holds every link; a group is a sixteenth or less of the bits
   apart from its neighbours and usually tiny.
3. A group above ``GROUP_LIMIT`` is dealt again by pairs of blocks of its
   free bits, which loses no link and bounds a group by the values of the
   few bits still free.
4. Inside a group the fingerprints are sorted by Gray rank, so neighbours
   share most bits.  A node of the index holds the bits its fingerprints
   share and its parent's do not; a search adds up differences on these from
   the root down and drops a whole node once they exceed the distance.
5. A group gives each member at most one link, to the smallest fingerprint
   of its part, never all pairs; the links are joined into components.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import components
from .words import buffers, spans

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
#: Groups above this many fingerprints are dealt again by their free bits.
GROUP_LIMIT = 1024
FANOUT = 8

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """Fewer words than a shingle: the whole sequence is one; no words: zero."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    parts = map(line.__getitem__, map(slice, starts[:len(words) - size + 1].tolist(),
                                      ends[size - 1:].tolist()))
    hashes = np.array(list(map(xxhash.xxh64_intdigest, parts, repeat(42))), "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``(key, fp)`` per row, fp as a signed long."""
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            out = np.empty(batch.num_rows, "<u8")
            for i, j in spans(offsets):
                block = data[offsets[i]:offsets[j]].tobytes()
                at = (offsets[i:j + 1] - offsets[i]).tolist()
                for k in range(j - i):
                    out[i + k] = fingerprint(block[at[k]:at[k + 1]], shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view("<i8"))],
                                             names=["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    rank = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """The index of step 4 over distinct fingerprints."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps))]
        low, high = self.fps, self.fps
        levels = []
        while len(low) > 1 or not levels:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            levels.append((low, ~(low ^ high)))
        #: From the root down: pattern and the bits that are shared here first.
        self.levels = []
        above = np.zeros(1, np.uint64)
        for pattern, shared in reversed(levels):
            parent = np.arange(len(shared)) // FANOUT if self.levels else np.zeros(len(shared), int)
            self.levels.append((pattern, shared & ~above[parent]))
            above = shared
        self.levels.append((self.fps, ~above[np.arange(len(self.fps)) // FANOUT]))

    def near(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query index, position in ``fps``) within the distance."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        seen = np.zeros(len(queries), np.int64)
        for depth, (pattern, mask) in enumerate(self.levels):
            if depth:
                q, seen = np.repeat(q, FANOUT), np.repeat(seen, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                inside = node < len(pattern)
                q, seen, node = q[inside], seen[inside], node[inside]
            seen = seen + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            close = seen <= distance
            q, seen, node = q[close], seen[close], node[close]
        return q, node


def group_links(fps: np.ndarray, distance: int, batch: int = 64) -> list[tuple[int, int]]:
    """(member, smallest member of its part) for the linked members of one group."""
    if len(fps) == 2:
        near = int(fps[0] ^ fps[1]).bit_count() <= distance
        return [(int(fps.max()), int(fps.min()))] if near else []
    index = GrayIndex(fps)
    fps = index.fps
    free = np.ones(len(fps), bool)
    links = []
    for seed in np.argsort(fps):
        if not free[seed]:
            continue
        free[seed] = False
        wave = np.array([seed])
        while len(wave):
            found = []
            for i in range(0, len(wave), batch):
                _, at = index.near(fps[wave[i:i + batch]], distance)
                new = np.unique(at[free[at]])
                free[new] = False
                found.append(new)
            wave = np.concatenate(found)
            links += [(int(x), int(fps[seed])) for x in fps[wave]]
    return links


def _blocks(width: int, count: int) -> list[tuple[int, int]]:
    edges = [round(i * width / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _field(value, start: int, size: int):
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << size) - 1))


def candidate_groups(nodes: DataFrame, distance: int) -> DataFrame:
    """``(members array<long>)``, groups of two or more that hold every link (steps 2 and 3)."""
    blocks = _blocks(64, distance + 2)
    pairs = list(combinations(range(len(blocks)), 2))

    def key(x, y):
        (a, n), (b, m) = x, y
        return F.shiftleft(_field(F.col("fp"), a, n), m).bitwiseOR(_field(F.col("fp"), b, m))

    rows = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), key(blocks[x], blocks[y]).alias("k"))
        for t, (x, y) in enumerate(pairs)])).alias("g")).select("fp", "g.t", "g.k")
    large = materialize(rows.groupBy("t", "k").count().where(F.col("count") > GROUP_LIMIT)
                        .select("t", "k"), "large_groups")
    small = (rows.join(large, ["t", "k"], "left_anti").groupBy("t", "k")
             .agg(F.collect_list("fp").alias("members")))
    if large.isEmpty():
        return small.where(F.size("members") > 1).select("members")

    # The free bits of a pair of blocks are cut in the same way.
    again = []
    for t, (x, y) in enumerate(pairs):
        free = [b for i, (s, n) in enumerate(blocks) if i not in (x, y) for b in range(s, s + n)]
        cuts = [free[a:a + n] for a, n in _blocks(len(free), distance + 2)]
        for u, chosen in enumerate(combinations(cuts, 2)):
            mask = sum(1 << b for c in chosen for b in c)
            mask -= (1 << 64) if mask >> 63 else 0
            again.append(F.when(F.col("t") == t, F.struct(
                F.lit(u).alias("u"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v"))))
    dealt = (rows.join(large, ["t", "k"], "left_semi")
             .select("fp", "t", "k", F.explode(F.array_compact(F.array(*again))).alias("g"))
             .groupBy("t", "k", "g.u", "g.v").agg(F.collect_list("fp").alias("members")))
    return (small.select("members").union(dealt.select("members"))
            .where(F.size("members") > 1))


def classes(own: DataFrame, distance: int) -> DataFrame:
    """``(fp, least, root)`` of the distinct fingerprints in ``own(doc_id, fp)``: the least
    doc_id that has it, and one fingerprint for all that are linked."""
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")

    def link(batches):
        for batch in batches:
            links = [x for group in batch.column(0)
                     for x in group_links(np.array(group.values.to_numpy(), "<i8").view("<u8"), distance)]
            signed = np.array(links, "<u8").reshape(-1, 2).view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(signed[:, 0]), pa.array(signed[:, 1])],
                                             names=["a", "b"])

    roots = components(candidate_groups(nodes, distance).mapInArrow(link, "a long, b long"))
    return materialize(nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")), "classed")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS,
                    distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    A null or empty text has fingerprint zero and links like any other.
    Repeated rows each give a row.  A null doc_id stays null; component_id is
    the smallest doc_id of the class that isn't null (null if there is none).
    Other columns of ``docs`` are not read.
    """
    own = materialize(fingerprints(docs, shingle), "fingerprints")
    classed = classes(own, distance)
    # Written, so that the join reads it as it is and a large class can be split.
    least = materialize(classed.groupBy("root").agg(F.min("least").alias("component_id")), "classes")
    named = classed.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE,
             key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class, all columns kept: that with the smallest
    doc_id, of its texts in the class that with the smallest hash.

    Rows that share a doc_id are documents of their own where their texts
    differ; of equal rows (a null text equals an empty one) one stays.  A row
    without a doc_id stands behind all that have one, in an order by a hash of
    its text.  An empty table stays empty.
    """
    names = docs.columns
    name = "_identity"
    while any(n.lower().startswith(name) for n in names):
        name = "_" + name
    place, hashed, rank = f"{name}_place", f"{name}_hash", f"{name}_rank"
    known = docs.withColumn(hashed, F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    known = known.withColumn(place, F.coalesce(F.col(f"`{key}`").cast("long"),
                                               F.col(hashed).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)))
    identity = F.struct(F.col(place).alias("place"), F.col(hashed).alias("hash")).alias("doc_id")
    own = materialize(fingerprints(known.select(identity, F.col(f"`{text}`").alias("text")), shingle), "fingerprints")
    first = classes(own, distance).groupBy("root").agg(F.min("least").alias("least")).select(
        F.col("least.place").alias(place), F.col("least.hash").alias(hashed))
    # The join and the window share one deal of the texts.
    order = Window.partitionBy(place, hashed).orderBy(F.col(f"`{text}`").asc_nulls_last())
    return (known.join(first, [place, hashed], "left_semi").withColumn(rank, F.row_number().over(order))
            .where(F.col(rank) == 1).select(*[F.col(f"`{n}`") for n in names]))

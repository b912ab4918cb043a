"""Benchmark decontamination by winnowing.

A *word* is a run of letters, digits and characters beyond ASCII, A-Z
lower-cased.  A benchmark item's windows are its runs of ten words; an item of
fewer words is one window.

1. Winnowing: for windows of ``size`` words, k-grams of ``ceil(size / 2)``
   words are hashed and each window keeps the one with the least hash (the
   last of equals).  Equal windows keep the same k-gram at the same place, so
   a span of ``size`` words or more that two texts share always has a
   fingerprint in common.  Sizes are 10 and those of the shorter items.
2. The items' fingerprints make a bitmap of bounded size; a document's
   fingerprints that miss it can't join and are not shuffled.  Those that hit
   it carry the words around them.
3. Fingerprints of documents and items are joined.  Items with equal
   surroundings count as one there, so a line that many items share joins
   once.  Each match is extended to both sides as far as words agree; spans
   of at least a window are hits.

Words are compared by 64-bit hashes: a hit needs as many equal hashes in a row
as its window has words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.broadcast import sized_broadcast
from ..session import materialize
from .words import Run, class_of, mix, runs

WINDOW = 10
GAP = class_of((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Bits of the fingerprint bitmap: at most 2^29 (64 MB), 1024 for each fingerprint below that.
MOST_BITS, SPARE_BITS = 29, 10
_PAGE = 32768  # bits of one row of bitmap_construct_agg
_U = np.uint64


def gram_words(size: int) -> int:
    """Words of the k-grams of windows of ``size`` words."""
    return -(-size // 2)


def winnowed(run: Run, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of the k-grams that windows of ``size`` words keep."""
    k = gram_words(size)
    gram, first = run.shingles(words, k)
    span = size - k + 1
    n = len(gram) - span + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, np.int64)
    gram = mix(gram + _U(size))  # windows of different sizes don't meet
    least, at = gram[:n].copy(), np.arange(n)
    for s in range(1, span):
        take = gram[s:s + n] <= least
        least[take] = gram[s:s + n][take]
        at[take] = np.flatnonzero(take) + s
    whole = run.text[first[:n]] == run.text[first[span - 1:]]
    at = np.unique(at[whole])
    return gram[at], first[at]


def surroundings(run: Run, words: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """The words that windows over the k-grams at ``first`` may hold; 0 beyond the text."""
    k = gram_words(size)
    at = first[:, None] + np.arange(k - size, size)
    inside = (at >= 0) & (at < len(words))
    at = np.where(inside, at, 0)
    inside &= run.text[at] == run.text[first][:, None]
    return np.where(inside, words[at], _U(0))


def _hashes(run: Run) -> np.ndarray:
    return run.hashes() | _U(1)  # 0 stands for no word


def _lists(rows: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat)


def item_fingerprints(items: DataFrame, key: str, window: int) -> DataFrame:
    """``(size, hash, around, item)`` of ``items``."""
    kind = items.schema[key].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            for run in runs(batch.column(1), lower=True, gap=GAP):
                words, count = _hashes(run), run.counts()
                for size in range(1, window + 1):
                    own = count == size if size < window else count >= window
                    if not own.any():
                        continue
                    value, first = winnowed(run, words, size)
                    mine = own[run.text[first]]
                    value, first = value[mine], first[mine]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(value), size, np.int32)), pa.array(value.view(np.int64)),
                         _lists(surroundings(run, words, first, size)),
                         batch.column(0).take(pa.array(run.first + run.text[first]))],
                        names=["size", "hash", "around", "item"])

    return items.mapInArrow(scan, f"size int, hash long, around array<long>, item {kind}")


def hash_bitmap(prints: DataFrame) -> tuple[int, np.ndarray]:
    """(b, bitmap of the first b bits of every hash); b grows with the number of hashes to a bound."""
    distinct = prints.select("hash").distinct()
    n = distinct.count()
    bits = min(MOST_BITS, max(15, n.bit_length() + SPARE_BITS))
    place = F.shiftrightunsigned("hash", 64 - bits)
    rows = (distinct.select(F.floor(place / _PAGE).alias("page"), (place % _PAGE).alias("bit"))
            .groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for page, part in rows:
        bitmap[page * (_PAGE // 8):(page + 1) * (_PAGE // 8)] = np.frombuffer(part, np.uint8)
    return bits, bitmap


def document_fingerprints(docs: DataFrame, key: str, sizes: list[int], bits: int, bitmap) -> DataFrame:
    """A row ``(row, key, n_words)`` for each document, and ``(row, at, size, hash, around)`` for each
    fingerprint that the bitmap holds; ``at`` is the place of its first word."""
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for run in runs(batch.column(1), lower=True, gap=GAP):
                words, count = _hashes(run), run.counts()
                own = np.arange(row, row + run.n_texts)
                row += run.n_texts
                base = np.cumsum(count) - count
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), batch.column(0).slice(run.first, run.n_texts), pa.array(count.astype(np.int64)),
                     *[pa.nulls(len(own), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]],
                    names=names)
                for size in sizes:
                    value, first = winnowed(run, words, size)
                    place = value >> _U(64 - bits)
                    hit = (bitmap.value[place >> _U(3)] >> (place & _U(7)).astype(np.uint8)) & 1 > 0
                    value, first = value[hit], first[hit]
                    text = run.text[first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[text]), pa.nulls(len(text), batch.column(0).type),
                         pa.nulls(len(text), pa.int64()), pa.array(first - base[text]),
                         pa.array(np.full(len(text), size, np.int32)), pa.array(value.view(np.int64)),
                         _lists(surroundings(run, words, first, size))], names=names)

    names = ["row", "key", "n_words", "at", "size", "hash", "around"]
    return docs.mapInArrow(
        scan, f"`row` long, key {kind}, n_words long, at long, size int, hash long, around array<long>")


def extended(joined: DataFrame) -> DataFrame:
    """``(row, start, end, around_id)``: the spans, of a window at least, on which both sides agree."""
    def extend(batches):
        for batch in batches:
            size = np.asarray(batch.column(2))
            for s in np.unique(size):
                k = gram_words(int(s))
                own = batch.filter(pa.array(size == s))
                a, b = (np.asarray(own.column(i).flatten()).reshape(own.num_rows, -1) for i in (3, 4))
                same = (a == b) & (a != 0)
                side = int(s) - k
                left = np.logical_and.accumulate(same[:, :side][:, ::-1], axis=1).sum(axis=1)
                right = np.logical_and.accumulate(same[:, side + k:], axis=1).sum(axis=1)
                good = same[:, side:side + k].all(axis=1) & (left + k + right >= s)
                at = np.asarray(own.column(1))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array(at - left), pa.array(at + k + right), own.column(5)],
                    names=["row", "start", "end", "around_id"]).filter(pa.array(good))

    return joined.select("row", "at", "size", "own", "around", "around_id").mapInArrow(
        extend, "`row` long, start long, `end` long, around_id long")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit: words inside an occurrence of a window of an item; n_items: items
    with such a window, items_sha256 the hash of their sorted ids.  A null
    text has no words, an item without words no window.  Repeated documents
    each give a row; items that repeat an id are one.  An item without an id
    hits words, but is neither counted nor named.  Empty ``items`` hit
    nothing.  Other columns are not read.
    """
    def two(df, k, t):
        return df.select(F.col(f"`{k}`").alias("key"), F.col(f"`{t}`").cast("string").alias("text"))

    prints = materialize(item_fingerprints(two(items, item_key, item_text), "key", window), "winnowed_items")
    sizes = sorted(r[0] for r in prints.select("size").distinct().collect())
    bits, bitmap = hash_bitmap(prints)
    rows = materialize(document_fingerprints(two(docs, key, text), "key", sizes, bits,
                                             docs.sparkSession.sparkContext.broadcast(bitmap)), "winnowed_documents")
    around = materialize(prints.select("hash", "around").distinct()
                         .withColumn("around_id", F.monotonically_increasing_id()), "winnowed_surroundings")
    spans = materialize(extended(
        rows.where("hash IS NOT NULL").withColumnRenamed("around", "own")
        .join(sized_broadcast(around, 32 + 16 * window), "hash")).distinct(), "contaminated_spans")

    merged = F.aggregate(
        F.sort_array(F.collect_set(F.struct("start", "end"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda done, x: F.struct(
            (done["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], done["to"]))).alias("n"),
            F.greatest(x["end"], done["to"]).alias("to")), lambda done: done["n"])
    hits = spans.groupBy("row").agg(merged.alias("n_hit"))
    named = (prints.join(around, ["hash", "around"]).where("item IS NOT NULL")
             .select("around_id", F.col("item").cast("string").alias("item")).distinct())
    found = spans.select("row", "around_id").distinct().join(sized_broadcast(named, 64), "around_id").select(
        "row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    no_items = F.coalesce("items", F.array().cast("array<string>"))
    return (rows.where("hash IS NULL").select("row", "key", "n_words").join(hits, "row", "left")
            .join(found, "row", "left")
            .select(F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.size(no_items).cast("long").alias("n_items"),
                    F.sha2(F.array_join(no_items, ",").cast("binary"), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))

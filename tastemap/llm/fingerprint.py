"""Bottom-k sketches of word shingles, with built-in functions only.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a
text's shingles.  Sketches merge across parts (the k smallest of the union)
and estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD, let, with_positions

SHINGLE_WORDS = 5
K = 64


def shingle_hashes(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """Hashes of a text's shingles; fewer words than a shingle make one of all words, none make none.

    A word's hash is joined with its neighbours' by doubling: 2 words, 4 words, then the rest.
    """
    def joined(left: Column, right: Column, step: int) -> Column:
        return F.zip_with(left, F.slice(right, step + 1, F.greatest(F.size(right) - step, F.lit(0))),
                          lambda a, b: F.xxhash64(a, b))

    def of_words(single: Column) -> Column:
        def build(h: Column, have: int) -> Column:
            if have == size:
                return h
            if 2 * have <= size:
                return let(h, lambda x: build(joined(x, x, have), 2 * have))
            # The windows of `have` words that start `size - have` later overlap these.
            return let(h, lambda x: joined(x, x, size - have))
        full = let(single, lambda x: F.slice(build(x, 1), 1, F.greatest(F.size(x) - (size - 1), F.lit(0))))
        short = F.array(F.aggregate(single, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(F.size(single) == 0, single).when(F.size(single) < size, short).otherwise(full)

    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    return let(F.transform(words, lambda w: F.xxhash64(w)), of_words)


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, size: int = SHINGLE_WORDS) -> Column:
    """A null text has an empty sketch, as an empty one."""
    return smallest(shingle_hashes(F.coalesce(text, F.lit("")), size), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated shared part of the union, 0 to 1; two empty sketches are alike."""
    both = F.size(F.array_intersect(a, b))
    # Equal sketches and sketches without a common hash need no union.
    exact = let(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return (F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(exact)).cast("double")


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated distinct shingles; exact for a sketch that isn't full."""
    share = (F.element_at(a, -1).cast("double") + 2.0 ** 63) / 2.0 ** 64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of ``a``'s shingles that ``b`` has."""
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def text_form(a: Column) -> Column:
    """16 lower-case hex digits a hash."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    Edited: the last floor(n_chars / 3) characters give way to as many of the
    beginning of the next document in descending doc_id (or all it has); after
    the last comes the first.  Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, distinct_shingles.

    A null text is empty.  Null doc_ids come last.  Rows with one doc_id are
    documents of their own, ordered by a hash of the text; fully repeated rows
    are one document in the order and each gives the same row.  A single
    document is its own next one.  Other columns are not read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), body.alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    order = with_positions(
        materialize(rows.groupBy("doc_id", "h").agg(F.max(F.length("text")).cast("long").alias("n_chars")),
                    "fingerprint_rows"),
        [F.desc_nulls_last("doc_id"), F.col("h")], "fingerprint_order")
    order = materialize(order, "fingerprint_positions")
    n = order.count()
    before = order.select(F.col("doc_id").alias("to_id"), F.col("h").alias("to_h"),
                          F.floor(F.col("n_chars") / 3).cast("int").alias("wanted"),
                          F.pmod(F.col("position") + 1, F.lit(max(n, 1))).alias("position"))
    # Each document with the one before it, to which it lends its beginning.
    pairs = materialize(order.join(before, "position").select("doc_id", "h", "to_id", "to_h", "wanted"),
                        "fingerprint_next")

    def same(a, b, names):
        cond = [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{y}")) for x, y in names]
        return cond[0] & cond[1]

    lent = rows.alias("d").join(
        pairs.alias("p"), same("d", "p", [("doc_id", "doc_id"), ("h", "h")])).select("p.to_id", "p.to_h", F.expr("substring(d.text, 1, p.wanted)").alias("begin"),
                       sketch(F.col("d.text"), k).alias("next_sketch")).dropDuplicates(["to_id", "to_h"])
    both = rows.alias("d").join(lent.alias("n"), same("d", "n", [("doc_id", "to_id"), ("h", "to_h")]))
    chars = F.length("d.text")
    out = both.select("d.doc_id", chars.cast("long").alias("n_chars"), F.col("d.text").alias("text"),
                      F.concat(F.expr("substring(d.text, 1, length(d.text) - CAST(floor(length(d.text) / 3) AS INT))"),
                               F.col("n.begin")).alias("edited"), "n.next_sketch")
    out = out.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
                     sketch(F.col("text"), k).alias("own"), sketch(F.col("edited"), k).alias("changed"), "next_sketch")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", text_form(F.col("own")).alias("fingerprint"),
        text_form(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("own"), k).alias("distinct_shingles"))

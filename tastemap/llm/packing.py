"""Best-fit packing by large-item matching, exact over all documents.

Lengths are whole numbers up to the capacity, so which lengths share a bin
depends on the histogram of lengths only, a table of at most ``capacity``
rows.  On it, classes of equal bins are built:

1. Large pieces (over a third of the capacity), longest first, open a bin
   each and are matched greedily with the longest large piece that still
   fits; a bin holds at most two of them.
2. Small pieces, longest first, go into the tightest gap that holds them;
   a new bin is opened when there is none.

A class is a list of lengths and a number of bins.  The k-th piece of a
length, in the corpus, takes the k-th place for that length.  Only the
histogram and the classes are in one place; the documents' ranks within their
length are found in parallel and looked up in the classes.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import materialize
from .bpe import CHARACTERS
from .common import with_positions
from .words import buffers

CAPACITY = 1024
END_ID = 2


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Classes ``(lengths, bins)`` that hold every piece of the histogram."""
    left = {n: c for n, c in histogram.items() if n > 0 and c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    #: gap -> {lengths in the bin: number of such bins}
    gaps: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    order: list[int] = []

    def put(lengths: tuple[int, ...], bins: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in gaps:
            insort(order, gap)
        gaps[gap][lengths] += bins

    for n in reversed(large):
        while left[n]:
            partner = next((m for m in reversed(large)
                            if m <= capacity - n and left[m] > (1 if m == n else 0)), None)
            if partner is None:
                bins, left[n] = left[n], 0
                put((n,), bins)
            else:
                bins = left[n] // 2 if partner == n else min(left[n], left[partner])
                left[n] -= bins
                left[partner] -= bins
                put((n, partner), bins)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            i = bisect_left(order, n)
            if i == len(order):
                # No gap is left: the rest of this length opens new bins.
                per = capacity // n
                bins = left[n] // per
                if bins:
                    put((n,) * per, bins)
                if left[n] % per:
                    put((n,) * (left[n] % per), 1)
                left[n] = 0
                break
            gap = order[i]
            lengths, bins = next(iter(gaps[gap].items()))
            # Equal bins take as many of this length as fit, one bin after the other.
            per = min(gap // n, left[n])
            full = min(bins, left[n] // per)
            put(lengths + (n,) * per, full)
            left[n] -= full * per
            if bins == full:
                del gaps[gap][lengths]
                if not gaps[gap]:
                    del gaps[gap]
                    del order[bisect_left(order, gap)]
            else:
                gaps[gap][lengths] = bins - full
    return [(lengths, bins) for g in sorted(gaps) for lengths, bins in gaps[g].items()]


def places(classes: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """``(length, first rank, first sequence, offset)`` of each run of places."""
    taken: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for lengths, bins in classes:
        offset = 0
        for n in lengths:
            out.append((n, taken[n], sequence, offset))
            taken[n] += bins
            offset += n
        sequence += bins
    return out


class Encoder:
    """Ids of texts as a byte-level ``tokenizers`` file gives them.

    tiktoken, loaded with the file's own vocabulary, gives the same ids several
    times faster where the file's merges are in id order (checked) and the text
    stays below ``FAST_BELOW``, where both libraries agree on what a letter, a
    digit and a blank are, and holds none of the file's special tokens.
    ``tokenizers`` itself encodes every other text; a special token written out
    in a text is that token, one id.
    """

    #: Lead bytes from here on are code points from U+0240 on.
    FAST_BELOW = 0xC9

    def __init__(self, tokenizer_path: str, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.fast = None
        with open(tokenizer_path, encoding="utf-8") as lines:
            whole = json.load(lines)
        model = whole["model"]
        self.special = [t["content"] for t in whole.get("added_tokens") or []]
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        vocabulary = model["vocab"]
        if pattern and all(vocabulary.get(m) == 256 + i for i, m in enumerate(merges)):
            byte = {c: b for b, c in enumerate(CHARACTERS)}
            ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items()
                     if i < 256 + len(merges)}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: np.ndarray) -> bytes:
        """Little-endian unsigned 32-bit ids of a text's UTF-8 bytes."""
        string = text.tobytes().decode()
        if (self.fast is not None and (not len(text) or text.max() < self.FAST_BELOW)
                and not any(s in string for s in self.special)):
            return self.fast.encode_to_numpy(string, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.tokenizer.encode(string, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str | None, capacity: int = CAPACITY,
           end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, piece, start, length, ids_crc32``: every text's ids and the end id, cut where longer."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = Encoder(tokenizer_path, pattern)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            at = offsets.tolist()
            of, piece, start, length, crc = [], [], [], [], []
            for k in range(batch.num_rows):
                ids = encoder.encode(data[at[k]:at[k + 1]]) + end
                n = len(ids) // 4
                first = n % capacity or min(n, capacity)
                edges = [0, *range(first, n + 1, capacity)]
                for p, (a, b) in enumerate(zip(edges, edges[1:])):
                    of.append(k)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a:4 * b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()),
                 *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                names=["key", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long")
            .withColumnRenamed("key", key))


def pack(items: DataFrame, capacity: int = CAPACITY, tie: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``items(length, ...)`` plus ``sequence_id`` and ``offset``."""
    items = materialize(items, "pack_pieces")  # dealing by range reads its input twice
    ranked = materialize(with_positions(items, [F.col("length"), *map(F.col, tie)], "pack_items",
                                        group="length", position="_rank"), "pack_ranked")
    histogram = {int(r["length"]): r["count"] for r in ranked.groupBy("length").count().collect()}
    if any(n > capacity for n in histogram):
        raise ValueError(f"a piece is longer than {capacity}")
    found = np.array(sorted(places(plan_bins(histogram, capacity))), np.int64).reshape(-1, 4)
    # One sorted number per run of places: length, then rank.
    starts = found[:, 0] * (1 << 50) + found[:, 1]
    fields = ranked.schema.names

    def run(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(fields.index(c))) for c in ("length", "_rank"))
            at = np.searchsorted(starts, length * (1 << 50) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found[at, 2] + rank - found[at, 1]), pa.array(found[at, 3])],
                names=[*fields, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long").drop("_rank")


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str | None = None,
                   capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end id alone.  Repeated rows are
    packed each on its own.  No rows give no rows; other columns are not read.
    """
    return pack(pieces(docs, tokenizer_path, pattern, capacity), capacity)

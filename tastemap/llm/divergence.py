"""Source divergence audit: how far the term use of a language's sources lies apart.

A *term* is a run of ASCII letters and characters beyond ASCII, A-Z lower-cased.

1. A map task packs its terms by length: up to 8 bytes are one ``uint64``, up
   to 16 two, big-endian and zero-filled, so numeric order is byte order.  Each
   bucket is sorted by an LSD radix sort over 16-bit digits and its runs are
   counted; terms beyond 16 bytes are sorted as bytes in buckets of their own,
   one for each power of two of their length.
2. Counts and document counts are summed by (lang, source, packed term), so no
   source and no frequent term is in one place before it has been combined.
3. A language keeps the terms that enough of its documents hold.  Smoothed
   frequencies are integers (parts of 10^9, floored), computed exactly.
4. The distance of two sources is the sum of the differences over all kept
   terms.  The terms of a language are dealt into buckets, its sources into
   blocks, so that a task has a bounded matrix; partial sums are added up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.broadcast import sized_broadcast
from ..session import materialize
from .words import class_of, runs

LEAST_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Terms that a map task sorts at once.
MAP_TERMS = 1_000_000
#: Cells of a task's (term, source) matrix, and pairs of sources it gives.
MATRIX_CELLS, TASK_PAIRS = 400_000, 2_000_000

GAP = class_of((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
TERM = ["w0", "w1", "long_term"]
_U = np.uint64


def _bytes_at(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """A row of ``width`` bytes from each start, zero beyond each length."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, width), (1, 1))[start]
    rows[np.arange(width) >= length[:, None]] = 0
    return rows


def packed(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Up to 8 bytes from each start as a big-endian number, zero-filled."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))[start].view(">u8").ravel()
    spare = (_U(8) * (_U(8) - np.minimum(length, 8).astype(_U)))
    return (word.astype(_U) >> spare) << spare


def radix_order(*keys: np.ndarray) -> np.ndarray:
    """The stable order by ``keys``, the most significant first: a radix sort over 16-bit digits."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in (0, 16, 32, 48):
            digit = ((key >> _U(shift)) & _U(0xFFFF)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_counts(doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows: (first row, rows, documents) of every run of equal ``keys``."""
    new = np.ones(len(doc), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    return first, np.diff(np.append(first, len(doc))), np.add.reduceat(other, first, dtype=np.int64)


class _Buckets:
    """Terms of a map task, by length, until they are counted."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.one: list[tuple] = []
        self.two: list[tuple] = []
        self.long: dict[int, list[tuple]] = {}
        self.terms = self.docs = self.long_bytes = 0

    def add(self, run, group: np.ndarray) -> None:
        length = run.end - run.start
        group, doc = group[run.text].astype(_U), run.text + self.docs
        short, middle = length <= 8, (length > 8) & (length <= 16)
        first = packed(run.data, run.start, length)
        self.one.append((group[short], first[short], doc[short]))
        self.two.append((group[middle], first[middle],
                         packed(run.data, run.start[middle] + 8, length[middle] - 8), doc[middle]))
        rest = np.flatnonzero(length > 16)
        if len(rest):
            bucket = np.ceil(np.log2(length[rest])).astype(np.int64)
            for b in np.unique(bucket):
                at = rest[bucket == b]
                width = int(length[at].max())
                self.long.setdefault(int(b), []).append(
                    (group[at], _bytes_at(run.data, run.start[at], length[at], width).view(f"S{width}").ravel(), doc[at]))
                self.long_bytes += width * len(at)
        self.terms += len(length)
        self.docs += run.n_texts

    def counted(self):
        """Rows of (group, w0, w1, long term or None, n, docs)."""
        for held in (self.one, self.two):
            group, *words, doc = (np.concatenate(x) for x in zip(*held))
            if len(doc):
                order = radix_order(group, *words)
                group, *words, doc = (x[order] for x in (group, *words, doc))
                first, n, docs = run_counts(doc, group, *words)
                w1 = words[1][first] if len(words) > 1 else np.zeros(len(first), _U)
                yield group[first], words[0][first], w1, None, n, docs
        for held in self.long.values():
            group, term, doc = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(term, kind="stable")
            order = order[radix_order(group[order])]
            group, term, doc = group[order], term[order], doc[order]
            first, n, docs = run_counts(doc, group, term)
            zero = np.zeros(len(first), _U)
            yield group[first], zero, zero, pa.array(term[first].tolist(), pa.binary()).cast(pa.string()), n, docs

    def batches(self, size: int = 100_000):
        names = list(self.groups)
        lang, source = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
        for group, w0, w1, term, n, docs in self.counted():
            at = pa.array(group.astype(np.int64))
            batch = pa.RecordBatch.from_arrays(
                [lang.take(at), source.take(at), pa.array(w0.view(np.int64)), pa.array(w1.view(np.int64)),
                 pa.nulls(len(n), pa.string()) if term is None else term, pa.array(n), pa.array(docs)],
                names=["lang", "source", *TERM, "n", "docs"])
            for i in range(0, batch.num_rows, size):
                yield batch.slice(i, size)


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, w0, w1, long_term, n, docs)`` summed over ``docs(lang, source, text)``."""
    def count(batches):
        held = _Buckets()
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            pairs = list(pairs)
            for run in runs(batch.column(2), lower=True, gap=GAP):
                group = np.array([held.groups.setdefault(p, len(held.groups))
                                  for p in pairs[run.first:run.first + run.n_texts]], np.int64)
                held.add(run, group)
                if held.terms >= MAP_TERMS or held.long_bytes >= 64 * MAP_TERMS:
                    yield from held.batches()
                    held = _Buckets()
        if held.docs:
            yield from held.batches()

    rows = docs.select("lang", "source", "text").mapInArrow(
        count, "lang string, source string, w0 long, w1 long, long_term string, n long, docs long")
    return rows.groupBy("lang", "source", *TERM).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), exact: three digits a step, so nothing passes 64 bits."""
    rest, below = np.asarray(n) + SMOOTHING, np.asarray(total) + SMOOTHING * terms
    out = np.zeros(np.broadcast(rest, below).shape, np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


def _scaled(n: str, total: str, terms: str):
    return F.expr(f"1 + (CAST({n} + {SMOOTHING} AS DECIMAL(20, 0)) * {SCALE}) "
                  f"DIV CAST({total} + {SMOOTHING} * {terms} AS DECIMAL(20, 0))")


def term_text():
    """The term of a packed row."""
    both = F.concat(*[F.unhex(F.lpad(F.hex(w), 16, "0")) for w in ("w0", "w1")]).cast("string")
    return F.coalesce("long_term", F.rtrim(both, F.lit("\0")))


def distances(counts: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for every two sources of a language, both ways.

    ``counts``: kept terms; ``groups(lang, source, total)``: all of them;
    ``langs(lang, terms, sources)``.
    """
    shape = langs.select(
        "lang", "terms", F.ceil(F.col("terms") * F.col("sources") / MATRIX_CELLS).cast("int").alias("_buckets"),
        F.ceil(F.col("sources") * F.col("sources") / TASK_PAIRS).cast("int").alias("blocks"))
    shape = sized_broadcast(shape.withColumn("buckets", F.greatest("_buckets", F.lit(1))).drop("_buckets"), 64)
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    left = (counts.join(shape, "lang").select("lang", "source", "n", F.xxhash64(*TERM).alias("term"), "buckets", "blocks")
            .select("lang", "source", "n", "term", F.expr("pmod(term, buckets)").cast("int").alias("bucket"), block))
    right = (groups.join(shape, "lang")
             .select("lang", "source", "total", "terms", "blocks",
                     F.expr("pmod(xxhash64(source), blocks)").cast("int").alias("own"),
                     F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
             .select("lang", "source", "total", "terms", "own", "bucket", block))

    def sums(own: pa.Table, sources: pa.Table) -> pa.Table:
        own, sources = own.combine_chunks(), sources.combine_chunks()
        name = np.array(sources["source"].to_pylist(), object)
        first = {n: i for i, n in reversed(list(enumerate(name)))}
        mine = np.flatnonzero(sources["own"].to_numpy() == sources["block"].to_numpy())
        found, codes = np.unique(own["term"].to_numpy(), return_inverse=True)
        matrix = np.zeros((len(found), len(name)), np.int64)
        place = np.array([first[n] for n in own["source"].to_pylist()], np.int64)
        np.add.at(matrix, (codes, place), own["n"].to_numpy())
        if len(found):
            matrix = scaled(matrix, sources["total"].to_numpy(), sources["terms"][0].as_py())
        value = np.array([np.abs(matrix - matrix[:, [i]]).sum(axis=0) for i in mine], np.int64).reshape(len(mine), len(name))
        other = np.arange(len(name)) != mine[:, None]
        at, item = np.nonzero(other)
        lang = sources["lang"][0].as_py() if len(name) else ""
        return pa.table([pa.array([lang] * len(at), pa.string()), pa.array(name[mine[at]], pa.string()),
                         pa.array(name[item], pa.string()), pa.array(value[other])],
                        names=["lang", "source", "item", "value"])

    keys = ("lang", "bucket", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        sums, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
          least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: each other source of the language and the distance to it,
    all ranks, farthest first.  Part ``term``: the ``top`` terms that the
    source uses more than its language does, and by how much.  Ties by item.

    A null language, source or text is an empty one.  A row is a document,
    repeated rows too.  A source without terms has its pairs; where a
    language keeps no term they have value 0.  A language's only source has
    no pairs.  An empty table gives no rows.  Other columns are not read.
    """
    own = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
                        for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = materialize(term_counts(own), "divergence_counts")
    kept = materialize(counts.groupBy("lang", *TERM).agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                       .where(F.col("docs") >= least_docs).drop("docs"), "divergence_kept")
    term = [F.col(f"c.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("lang", *TERM)]
    small = materialize(
        counts.alias("c").join(sized_broadcast(kept, 96).alias("k"), [t for t in term])
        .select("c.lang", "c.source", *[f"c.{t}" for t in TERM], "c.n", "k.lang_n"), "divergence_terms")
    totals = small.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = materialize(own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
                         .na.fill(0, ["total"]), "divergence_groups")
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    langs = materialize(groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(terms, "lang", "left")
                        .na.fill(0, ["terms", "lang_total"]), "divergence_langs")

    pairs = distances(small, groups, langs).withColumn("part", F.lit("pair"))
    used = (small.join(sized_broadcast(groups, 64), ["lang", "source"]).join(sized_broadcast(langs, 64), "lang")
            .select("lang", "source", F.lit("term").alias("part"), term_text().alias("item"),
                    (_scaled("n", "total", "terms") - _scaled("lang_n", "lang_total", "terms")).alias("value"))
            .where("value > 0"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value"]
    ranked = [df.select(*columns, F.row_number().over(order).alias("rank")) for df in (pairs, used)]
    return ranked[0].union(ranked[1].where(F.col("rank") <= top))

"""Phrase collocations from weighted acyclic automata.

The n-grams of a text are the paths of up to three words that start at each of
its words and end at a piece's end at the latest; a prefix of a path is an
n-gram, too, and its count is the weight of all paths through it.

1. A map task sorts the paths of its shard and builds a count transducer from
   them: a state for each prefix that differs from the one before, transitions
   labelled with words, weights on the last ones.
2. Paths are ordered by hashes of their first, second and third word, and that
   order is cut into ranges by quantiles of a bounded sample, which decide
   nothing but the balance: a prefix that a third of all words start with is
   spread over a third of the ranges.  A shard sends each range the part of
   its transducer that lies there.
3. The transducers of a range are united, weights of equal paths added, and
   weights summed by prefix.  Only a prefix that crosses the end of a range
   has partial sums in two; they are added in the end.  Labels are words, not
   hashes, throughout: counts are exact.
4. Candidates are composed with the counts of their parts.  A part of a
   frequent phrase is as frequent at least, so parts are found among the
   frequent n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.broadcast import sized_broadcast
from ..session import materialize
from .common import partitions_of
from .words import Run, buffers, class_of, mix, runs

LEAST = 10
TOP = 2000
SCORE_SCALE = 1_000_000
#: A shorter phrase goes if a longer one around it has this share of its count, in percent.
COVERED = 50
#: Words of a shard, bytes of text for each range, documents and places of the sample for the ranges.
SHARD_WORDS, RANGE_BYTES, SAMPLE_DOCS, SAMPLE_PLACES = 1 << 20, 4_000_000, 4_000, 64
#: Paths of a range that are held before they are united.
HELD_PATHS = 4_000_000

BREAK = class_of((0x0A, 0x0D)) | np.isin(np.arange(256), [ord(c) for c in ".,;:!?"])
GAP = BREAK | class_of((0x20, 0x20), (0x09, 0x09))
_LABEL_BITS = 21
_U = np.uint64


class Transducer:
    """An acyclic automaton over words with a weight for each path of three labels.

    ``words``: the labels, the first of them the empty word that stands for the
    end of a piece.  Level k has a label for each state and how many states
    follow it; the last level has weights.
    """

    def __init__(self, words: pa.Array, labels: list[np.ndarray], follow: list[np.ndarray], weight: np.ndarray):
        self.words, self.labels, self.follow, self.weight = words, labels, follow, weight

    @classmethod
    def build(cls, words: pa.Array, paths: list[np.ndarray], weight: np.ndarray) -> Transducer:
        """From distinct paths that are sorted, so that equal prefixes stand together."""
        new = np.zeros(len(weight), bool)
        new[:1] = True
        starts, labels = [], []
        for path in paths[:-1]:
            new = new.copy()
            new[1:] |= path[1:] != path[:-1]
            starts.append(np.flatnonzero(new))
            labels.append(path[new])
        n = len(weight)
        second = np.searchsorted(starts[1], np.append(starts[0], n))
        return cls(words, [*labels, paths[-1]], [np.diff(second), np.diff(np.append(starts[1], n))], weight)

    def paths(self) -> list[np.ndarray]:
        deep = np.repeat(self.labels[1], self.follow[1])
        return [np.repeat(np.repeat(self.labels[0], self.follow[0]), self.follow[1]), deep, self.labels[2]]

    def to_bytes(self) -> bytes:
        data, offsets = buffers(self.words)
        used = np.unique(np.concatenate(self.labels + [np.zeros(1, self.labels[0].dtype)]))
        own = pa.array(self.words.take(pa.array(used)))
        data, offsets = buffers(own)
        parts = [np.diff(offsets), *[np.searchsorted(used, x) for x in self.labels], *self.follow]
        head = np.array([len(used), *[len(x) for x in self.labels]], "<u4")
        return b"".join([head.tobytes(), *[x.astype("<u4").tobytes() for x in parts],
                         self.weight.astype("<i8").tobytes(), data[offsets[0]:offsets[-1]].tobytes()])

    @classmethod
    def from_bytes(cls, blob: bytes) -> Transducer:
        n, *levels = np.frombuffer(blob, "<u4", 4).tolist()
        at, got = 16, []
        for size in (n, *levels, levels[0], levels[1]):
            got.append(np.frombuffer(blob, "<u4", size, at).astype(np.int64))
            at += 4 * size
        weight = np.frombuffer(blob, "<i8", levels[2], at)
        at += 8 * levels[2]
        offsets = np.concatenate([[0], np.cumsum(got[0])])
        words = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(blob[at:])])
        return cls(words, got[1:4], got[4:6], weight)

    @classmethod
    def union(cls, parts: list[Transducer]) -> Transducer:
        """All paths of ``parts``, weights of equal ones added."""
        coded = pa.concat_arrays([p.words for p in parts]).dictionary_encode()
        place = np.asarray(coded.indices).astype(np.int64)
        base = np.cumsum([0] + [len(p.words) for p in parts])
        columns = zip(*[[place[path + b] for path in p.paths()] for p, b in zip(parts, base)])
        paths = [np.concatenate(c) for c in columns]
        return cls.build(coded.dictionary, *added(paths, np.concatenate([p.weight for p in parts]), len(coded.dictionary)))

    def prefix_sums(self) -> list[tuple[list[np.ndarray], np.ndarray]]:
        """(labels, weight of all paths through it) of the prefixes of one, two and three words."""
        second = np.add.reduceat(self.weight, np.cumsum(self.follow[1]) - self.follow[1])
        first = np.add.reduceat(second, np.cumsum(self.follow[0]) - self.follow[0])
        return [([self.labels[0]], first), ([np.repeat(self.labels[0], self.follow[0]), self.labels[1]], second),
                (self.paths(), self.weight)]


def added(paths: list[np.ndarray], weight: np.ndarray, n_words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct paths and their summed weights."""
    bits = max(1, int(n_words - 1).bit_length())
    if 3 * bits > 63:  # too many words for one number: the first two labels become one
        pair, place = np.unique((paths[0] << 32) | paths[1], return_inverse=True)
        key = (place.astype(np.int64) << 32) | paths[2]
    else:
        key = (((paths[0] << bits) | paths[1]) << bits) | paths[2]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return [p[order][first] for p in paths], np.add.reduceat(weight[order], first)


def label_keys(words: pa.Array, lang: str) -> np.ndarray:
    """21 bits of a hash of each word with its language; 0 for the empty word alone."""
    data, offsets = buffers(words)
    seed = int.from_bytes(lang.encode(), "little") % (1 << 64)
    run = Run(0, data[offsets[0]:offsets[-1]], None, offsets[:-1] - offsets[0], offsets[1:] - offsets[0], None)
    key = mix(run.hashes() + mix(np.array([seed], _U))) >> _U(64 - _LABEL_BITS)
    return np.where(np.diff(offsets) == 0, 0, np.maximum(key, _U(1))).astype(np.int64)


def _key(labels: list[np.ndarray]) -> np.ndarray:
    return (((labels[0] << _LABEL_BITS) | labels[1]) << _LABEL_BITS) | labels[2]


def _shards(batches):
    """Yields (language, words, paths, one per word) whenever ``SHARD_WORDS`` words of all languages are held."""
    held: dict[str, list] = {}
    count = 0

    def flush(lang):
        texts, one, two, start = zip(*held.pop(lang))
        coded = pa.concat_arrays([pa.array([""], pa.large_string()), *texts]).dictionary_encode()
        code = np.asarray(coded.indices).astype(np.int64)[1:]
        after = np.append(code, [0, 0])
        start = np.concatenate(start)
        paths = [code, np.where(np.concatenate(one), after[1:-1], 0), np.where(np.concatenate(two), after[2:], 0)]
        return lang, coded.dictionary, [p[start] for p in paths]

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for run in runs(batch.column(1), lower=True, gap=GAP):
            if not len(run.start):
                continue
            cuts = np.cumsum(BREAK[run.data])[run.start]
            one = np.append((cuts[1:] == cuts[:-1]) & (run.text[1:] == run.text[:-1]), False)
            two = one & np.append(one[1:], False)
            offsets = np.concatenate([[0], np.cumsum(run.end - run.start)])
            words = pa.Array.from_buffers(pa.large_string(), len(run.start),
                                          [None, pa.py_buffer(offsets), pa.py_buffer(run.data[~GAP[run.data]])])
            base = np.searchsorted(run.text, np.arange(run.n_texts + 1)).tolist()
            for i in range(run.n_texts):
                lang = langs[run.first + i]
                for a in range(base[i], base[i + 1], SHARD_WORDS):
                    # The two words behind a cut end its last paths; as starts they come in the next shard.
                    b, c = min(a + SHARD_WORDS, base[i + 1]), min(a + SHARD_WORDS + 2, base[i + 1])
                    held.setdefault(lang, []).append((words.slice(a, c - a), one[a:c], two[a:c], np.arange(a, c) < b))
                    count += c - a
                    if count >= SHARD_WORDS:
                        for each in list(held):
                            yield flush(each)
                        count = 0
    for lang in list(held):
        yield flush(lang)


def range_bounds(docs: DataFrame) -> np.ndarray:
    """Keys that cut the order of all paths into ranges of about ``RANGE_BYTES`` of text, by a bounded sample."""
    n, size = docs.agg(F.count("text"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = max(1, -(-size // RANGE_BYTES))
    if ranges == 1:
        return np.empty(0, np.int64)

    def keys(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for lang, words, paths in _shards([batch.slice(i, 1)]):
                    at = np.linspace(0, len(paths[0]) - 1, min(SAMPLE_PLACES, len(paths[0]))).astype(np.int64)
                    label = label_keys(words, lang)
                    yield pa.RecordBatch.from_arrays([pa.array(_key([label[p[at]] for p in paths]))], names=["key"])
                    break

    sample = docs.sample(min(1.0, SAMPLE_DOCS / max(1, n)), seed=13)
    found = np.sort(np.array([r[0] for r in sample.mapInArrow(keys, "key long").collect()], np.int64))
    if not len(found):
        return np.empty(0, np.int64)
    return np.unique(found[(np.arange(1, ranges) * len(found)) // ranges])


def ngram_counts(docs: DataFrame, least: int) -> DataFrame:
    """``(lang, w1, w2, w3, f)`` of ``docs(lang, text)``: n-grams of one to three words (the others null) with a
    count of ``least`` or more, and for each language a row without words and the number of all its words."""
    bounds = range_bounds(docs)

    def shards(batches):
        for lang, words, paths in _shards(batches):
            paths, weight = added(paths, np.ones(len(paths[0]), np.int64), len(words))
            label = label_keys(words, lang)
            part = np.searchsorted(bounds, _key([label[p] for p in paths]), "right")
            order = np.argsort(part, kind="stable")
            found, first = np.unique(part[order], return_index=True)
            ends = np.append(first[1:], len(order))
            blobs = [Transducer.build(words, [p[order[a:b]] for p in paths], weight[order[a:b]]).to_bytes()
                     for a, b in zip(first, ends)]
            for i in range(0, len(blobs), 64):
                own = blobs[i:i + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[i:i + 64]), pa.array([lang] * len(own), pa.string()), pa.array(own, pa.binary())],
                    names=["part", "lang", "blob"])

    def sums(lang, held):
        whole = Transducer.union(held)
        label, total = label_keys(whole.words, lang), int(whole.weight.sum())
        yield rows(lang, whole.words, [], np.array([total]))
        for depth, (labels, weight) in enumerate(whole.prefix_sums(), 1):
            low = [label[x] for x in labels]
            spare = [np.zeros_like(weight)] * (3 - depth)
            crosses = (np.searchsorted(bounds, _key(low + spare), "right")
                       != np.searchsorted(bounds, _key(low + [s + (1 << _LABEL_BITS) - 1 for s in spare]), "right"))
            take = ((weight >= least) | crosses) & (labels[-1] != 0)
            yield rows(lang, whole.words, [x[take] for x in labels], weight[take])

    def rows(lang, words, labels, weight):
        n = len(weight)
        columns = [words.take(pa.array(x)).cast(pa.string()) for x in labels]
        columns += [pa.nulls(n, pa.string())] * (3 - len(labels))
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), *columns, pa.array(weight)],
                                          names=["lang", "w1", "w2", "w3", "f"])

    def unite(batches):
        held, at, count = [], None, 0
        for batch in batches:
            for part, lang, blob in zip(*[c.to_pylist() for c in batch.columns]):
                if held and at != (part, lang):
                    yield from sums(at[1], held)
                    held, count = [], 0
                at = part, lang
                held.append(Transducer.from_bytes(blob))
                count += len(held[-1].weight)
                if count >= HELD_PATHS and len(held) > 1:
                    held = [Transducer.union(held)]
                    count = len(held[0].weight) // 2
        if held:
            yield from sums(at[1], held)

    dealt = (docs.mapInArrow(shards, "part long, lang string, blob binary")
             .repartition(partitions_of(docs.sparkSession), "part", "lang").sortWithinPartitions("part", "lang"))
    return (dealt.mapInArrow(unite, "lang string, w1 string, w2 string, w3 string, f long")
            .groupBy("lang", "w1", "w2", "w3").agg(F.sum("f").alias("f"))
            .where((F.col("f") >= least) | F.col("w1").isNull()))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a a / (left right)), exact for counts below 10^15."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    scaled = (a * a).cast("decimal(31,0)") * F.lit(SCORE_SCALE).cast("decimal(7,0)")
    return F.call_function("div", scaled, (left * right).cast("decimal(31,0)"))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST,
                 top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of two or three words.

    a: the phrase's count; l and r: those of its parts at the cut of the
    lowest score, the first of equals; n: all words of the language.  Bigrams
    that a trigram covers are left out.  A null language is ``und``, a null
    text has no words; repeated rows count as often as they are there.  An
    empty table gives no rows.  Other columns are not read.
    """
    own = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                      F.col(f"`{text}`").cast("string").alias("text"))
    counts = materialize(ngram_counts(own, least), "ngram_counts")
    words = counts.where("w1 IS NULL").select("lang", F.col("f").alias("n"))
    single = counts.where("w1 IS NOT NULL AND w2 IS NULL").select("lang", "w1", "f")
    single = sized_broadcast(single, 64)

    def of(df: DataFrame, *names: str) -> DataFrame:
        return df.toDF("lang", *names)

    pairs = (counts.where("w2 IS NOT NULL AND w3 IS NULL").select("lang", "w1", "w2", F.col("f").alias("a"))
             .join(of(single, "w1", "l"), ["lang", "w1"]).join(of(single, "w2", "r"), ["lang", "w2"])
             .select("lang", "w1", "w2", "a", "l", "r"))
    pairs = materialize(pairs, "bigram_parts")
    triples = (counts.where("w3 IS NOT NULL").select("lang", "w1", "w2", "w3", F.col("f").alias("a"))
               .join(of(pairs, "w1", "w2", "l2", "l1", "_"), ["lang", "w1", "w2"]).drop("_")
               .join(of(pairs, "w2", "w3", "r1", "_", "r2"), ["lang", "w2", "w3"]).drop("_"))
    first, second = score(F.col("a"), F.col("l1"), F.col("r1")), score(F.col("a"), F.col("l2"), F.col("r2"))
    triples = materialize(triples.withColumn("s1", first).withColumn("s2", second).select(
        "lang", "w1", "w2", "w3", "a", F.least("s1", "s2").alias("score"),
        F.when(F.col("s1") <= F.col("s2"), F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(F.col("s1") <= F.col("s2"), F.col("r1")).otherwise(F.col("r2")).alias("r")), "trigram_parts")

    around = (of(triples.select("lang", "w1", "w2", "a"), "w1", "w2", "most")
              .union(of(triples.select("lang", "w2", "w3", "a"), "w1", "w2", "most"))
              .groupBy("lang", "w1", "w2").agg(F.max("most").alias("most")))
    left = (pairs.join(around, ["lang", "w1", "w2"], "left")
            .where(F.col("most").isNull() | (100 * F.col("most") < COVERED * F.col("a"))))
    columns = ["a", "l", "r", "score"]
    phrases = (left.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r",
                           score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
               .union(triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), *columns[:3], "score")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = phrases.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(sized_broadcast(words, 32), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

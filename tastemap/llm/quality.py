"""Quality by importance resampling: target against raw hashed n-gram models.

Two generative models over hashed n-grams, one of the target texts and one of
all texts, give every document an importance weight: the ratio of its
probabilities.  Gumbel noise on the log weights and a top-k then sample k
documents without replacement in proportion to their weights.

A target model of few texts gives words that it hasn't seen too little, which
lowers the ratio of a clean document with every n-gram.  How much is measured:
each target text is weighed by the model without it, and what the lowest of
them lack per n-gram is given back to every n-gram of every document.

n-grams: words and pairs of words, and runs of one to three word *forms*
(letter case, marks, numbers, same as an earlier word), so that the model
knows shouting, tables and stuttering in words it has never seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import with_positions
from .words import Run, mix, runs

BUCKETS = 1 << 16
#: Target documents that the target model is fitted on, at most.
TARGET_SAMPLE = 20_000
SMOOTHING = 0.5
SEED = 7
#: The default sample is as large as the number of documents above this log weight:
#: those that the raw model explains less than a thousand times better.
LEAST_LOG_WEIGHT = -6.9
#: Share of the target texts, each weighed without itself, that may fall below it.
HELD_OUT_LOST = 0.002

_CLASS = np.zeros((4, 256), np.int64)
_CLASS[0, 65:91] = 1                                             # upper case
_CLASS[1, 97:123] = 1                                            # lower case
_CLASS[2, 48:58] = 1                                             # digits
_CLASS[3, [b for b in range(33, 127) if not chr(b).isalnum()]] = 1  # marks


def forms(run: Run, word_hash: np.ndarray) -> np.ndarray:
    """A small code of each word's look."""
    counts = []
    for kind in _CLASS:
        total = np.concatenate(([0], np.cumsum(kind[run.data])))
        counts.append(total[run.end] - total[run.start])
    upper, lower, digits, marks = counts
    last = run.data[run.end - 1].astype(np.int64) if len(run.end) else np.empty(0, np.int64)
    same = np.zeros(len(word_hash), np.int64)
    same[1:] = (word_hash[1:] == word_hash[:-1]) & (run.text[1:] == run.text[:-1])
    code = np.minimum(upper, 2) * 3 + np.minimum(lower, 2)
    code = code * 2 + (digits > 0)
    code = code * 4 + np.minimum(marks, 3)
    return (code * 2 + same) * 256 + np.where(marks > 0, last, 0)


def ngrams(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every n-gram of a run of texts."""
    word = run.hashes()
    form = mix(forms(run, word).astype(np.uint64) + np.uint64(1 << 40))
    texts, buckets = [], []
    for values, size, salt in ((word, 1, 1), (word, 2, 2), (form, 1, 3), (form, 2, 4), (form, 3, 5)):
        got, first = run.shingles(values, size)
        texts.append(run.text[first])
        buckets.append((mix(got + np.uint64(salt)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(texts), np.concatenate(buckets)


@dataclass
class Model:
    """log(target / raw) of each bucket, and what an n-gram lacks for want of target texts (at most 0)."""

    log_ratio: np.ndarray
    lacking: float = 0.0

    def log_weights(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log importance weight and number of n-grams of each text."""
        sums, counts = [], []
        for run in runs(column):
            text, bucket = ngrams(run)
            sums.append(np.bincount(text, self.log_ratio[bucket] - self.lacking, minlength=run.n_texts))
            counts.append(np.bincount(text, minlength=run.n_texts))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        return join(sums, np.float64), join(counts, np.int64)


def fit(docs: DataFrame, targets: DataFrame, sample: int = TARGET_SAMPLE, key: str = "doc_id",
        text: str = "text") -> Model:
    """Raw counts come from every row of ``docs``, target counts from those whose key is
    among the first ``sample`` of ``targets`` by a hash of the key.

    What reaches the driver is one row per bucket and one number.  Without
    target or raw texts every ratio is one.
    """
    chosen = (targets.select(F.col(key).alias("_target")).where("_target IS NOT NULL").distinct()
              .orderBy(F.xxhash64("_target", F.lit(SEED)), "_target").limit(sample))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"))
    marked = rows.join(F.broadcast(chosen), F.col("_key") == F.col("_target"), "left").select(
        F.col("_target").isNotNull().alias("target"), "text")

    def count(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            target = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool)
            for run in runs(batch.column(1)):
                text, bucket = ngrams(run)
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[target[run.first + text]], minlength=BUCKETS)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0, used]), pa.array(total[1, used])],
                                         names=["bucket", "raw", "target"])

    counts = (marked.mapInArrow(count, "bucket long, raw long, target long")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts.bucket], target[counts.bucket] = counts.raw, counts.target
    if not raw.sum() or not target.sum():
        return Model(np.zeros(BUCKETS))
    lacking = held_out_lack(rows.join(F.broadcast(chosen), F.col("_key") == F.col("_target")).select("text"), raw, target)
    raw, target = (smoothed(c, c.sum()) for c in (raw, target))
    return Model(np.log(target / raw), lacking)


def smoothed(counts: np.ndarray, total: np.ndarray | float) -> np.ndarray:
    return (counts + SMOOTHING) / (total + SMOOTHING * BUCKETS)


def held_out_lack(texts: DataFrame, raw: np.ndarray, target: np.ndarray) -> float:
    """What has to be added per n-gram, as a number of at most 0 to be taken off, so that all target
    ``texts`` but ``HELD_OUT_LOST`` of them reach ``LEAST_LOG_WEIGHT`` by the model without their own counts.

    Few texts don't show the lowest that there is, and a text with copies is raised in the raw
    model: as much again as the lowest is below the median is the margin for texts not seen.
    """
    log_raw, total = np.log(smoothed(raw, raw.sum())), target.sum()

    def weigh_without(batches):
        for batch in batches:
            for run in runs(batch.column(0)):
                text, bucket = ngrams(run)
                size = np.bincount(text, minlength=run.n_texts)
                _, at, own = np.unique(text * BUCKETS + bucket, return_inverse=True, return_counts=True)
                weight = np.log(smoothed(target[bucket] - own[at], total - size[text])) - log_raw[bucket]
                sums = np.bincount(text, weight, minlength=run.n_texts)[size > 0]
                yield pa.RecordBatch.from_arrays([pa.array((sums - LEAST_LOG_WEIGHT) / size[size > 0])], names=["lack"])

    found = texts.mapInArrow(weigh_without, "lack double").agg(F.percentile_approx("lack", [HELD_OUT_LOST, 0.5])).first()[0]
    return 0.0 if found is None else min(0.0, 2 * found[0] - found[1])


def gumbel(key: str, text: str, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on a row's key and text only."""
    number = F.xxhash64(F.lit(seed), F.col(key), F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit((1 << 53) - 1))
    return -F.log(-F.log((number.cast("double") + 0.5) / float(1 << 53)))


def _free(names: list[str], wanted: str) -> str:
    while wanted.lower() in {n.lower() for n in names}:
        wanted = "_" + wanted
    return wanted


def weigh(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str, str, str]:
    """``docs``, all columns kept, plus log weight, n-grams and noisy key; and their names.

    The names get underscores in front where ``docs`` has them already.
    """
    weight, grams, noisy = (_free(docs.columns, n) for n in ("log_weight", "n_ngrams", "sample_key"))
    at = docs.columns.index(text)
    body = docs.withColumn(text, F.col(text).cast("string"))

    def run(batches):
        for batch in batches:
            found, counts = model.log_weights(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(counts)],
                                             names=[*batch.schema.names, weight, grams])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in body.schema.fields)
    scored = body.mapInArrow(run, f"{schema}, `{weight}` double, `{grams}` long")
    return scored.withColumn(noisy, F.col(weight) + gumbel(key, text)), weight, grams, noisy


def top_k_bound(keys: DataFrame, k: int) -> float | None:
    """The k-th largest ``sample_key`` (None: all rows are in), by a range sort of the keys."""
    if k <= 0:
        return float("inf")
    at = with_positions(keys.select("sample_key"), [F.desc("sample_key")], "sample_order")
    row = at.where(F.col("position") == k - 1).first()
    return None if row is None else row["sample_key"]


def resample(docs: DataFrame, model: Model, k: int | None = None, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_ngrams, log_weight, sample_key, kept.

    ``k`` documents are kept; by default as many as have a log weight of at
    least ``LEAST_LOG_WEIGHT``, which makes the sample as large as the part of
    the corpus that looks like the target.  A null or
    empty text has log weight 0.  Equal rows share their noise, so they are
    kept or not together, as are rows with the key of the k-th one.  Other
    columns of ``docs`` are not read.
    """
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored, *_ = weigh(narrow, model, "doc_id", "text")
    scored = materialize(scored.drop("text"), "sample_keys")
    bound = sample_bound(scored, k)
    return scored.withColumn("kept", F.lit(True) if bound is None else F.col("sample_key") >= bound)


def sample_bound(scored: DataFrame, k: int | None) -> float | None:
    if k is None:
        k = scored.where(F.col("log_weight") >= LEAST_LOG_WEIGHT).count()
    return top_k_bound(scored, k)


def keep_sample(docs: DataFrame, model: Model, k: int | None = None, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``resample`` keeps, all columns as they were."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    scored, weight, _, noisy = weigh(docs, model, key, text)
    keys = materialize(scored.select(F.col(weight).alias("log_weight"), F.col(noisy).alias("sample_key")), "sample_keys")
    bound = sample_bound(keys, k)
    return scored.where(F.lit(True) if bound is None else F.col(noisy) >= bound).select(*columns)

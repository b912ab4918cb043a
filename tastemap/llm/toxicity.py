"""Toxicity by cumulative-link ordinal regression on hashed words.

P(grade <= j) = logistic(threshold_j - w.x): one weight vector for all
grades, ordered thresholds, and the expected severity (the mean grade) as the
score.  x are log(1 + count) of lower-cased words without outer punctuation,
hashed into buckets.

Severity grades: labels say toxic or not.  Among the toxic labelled documents
the grade is the class (1-3) of the number of *marker* words in the text;
markers are words whose share of documents is at least ``MARKER_RATIO`` times
as high among toxic labelled documents as among the others.  Callers that
have grades pass them instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import runs

BUCKETS = 1 << 20
#: Labelled documents that the model is fitted on, at most.
LABEL_SAMPLE = 20_000
MARKER_RATIO = 20.0
#: Marker words from which a toxic document has grade 2 and 3.
GRADE_EDGES = (5, 12)
#: A word has a weight from this standard score on, if at least so many toxic documents, or documents, hold it.
LEAST_Z, LEAST_TOXIC, LEAST_OTHER = 4.0, 2, 5
ROUNDS = 400
RIDGE = 1e-4
#: A document is toxic from this expected severity on.
TOXIC_SEVERITY = 0.2


def features(column: pa.Array):
    """Yields (first text, texts, text index, bucket, count) of each run of texts."""
    for run in runs(column, lower=True):
        run.trimmed()
        pair = run.text.astype(np.int64) * BUCKETS + (run.hashes() % np.uint64(BUCKETS)).astype(np.int64)
        pair, count = np.unique(pair, return_counts=True)
        yield run.first, run.n_texts, pair // BUCKETS, pair % BUCKETS, count


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Model:
    buckets: np.ndarray     # sorted buckets with a weight
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than grades

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade = j), one column per grade."""
        below = _sigmoid(self.thresholds[None, :] - score[:, None])
        edges = np.hstack([np.zeros((len(score), 1)), below, np.ones((len(score), 1))])
        return np.diff(edges, axis=1)

    def scores(self, column: pa.Array) -> np.ndarray:
        dense = np.zeros(BUCKETS)
        dense[self.buckets] = self.weights
        parts = [np.bincount(text, dense[bucket] * np.log1p(count), minlength=n)
                 for _, n, text, bucket, count in features(column)]
        return np.concatenate(parts) if parts else np.empty(0)


def train(text: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int,
          n_grades: int, rounds: int = ROUNDS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the ordinal log likelihood.

    Thresholds are a first one and positive steps, so they stay in order.
    """
    n = len(grade)
    share = np.cumsum(np.bincount(grade, minlength=n_grades) + 1.0)[:-1] / (n + n_grades)
    first = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(n_features), first[:1], np.log(np.maximum(np.diff(first), 0.05))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        w, steps = params[:n_features], np.exp(params[n_features + 1:])
        theta = params[n_features] + np.concatenate(([0.0], np.cumsum(steps)))
        score = np.bincount(text, w[feature] * value, minlength=n)
        high = np.concatenate((theta, [np.inf]))[grade] - score
        low = np.concatenate(([-np.inf], theta))[grade] - score
        up, down = _sigmoid(high), _sigmoid(low)
        p = np.maximum(up - down, 1e-9)
        d_high, d_low = up * (1 - up) / p / n, down * (1 - down) / p / n
        g_score = d_high - d_low                       # of the loss, by the score
        g_theta = (np.bincount(grade, -d_high, minlength=n_grades)[:n_grades - 1]
                   + np.bincount(grade, d_low, minlength=n_grades)[1:])
        grad = np.concatenate([
            np.bincount(feature, g_score[text] * value, minlength=n_features) + ridge * w,
            [g_theta.sum()], steps * np.cumsum(g_theta[::-1])[::-1][1:]])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad ** 2
        rate = 0.1 * (1 - step / (rounds + 1))
        params -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-10)
    steps = np.exp(params[n_features + 1:])
    return params[:n_features], params[n_features] + np.concatenate(([0.0], np.cumsum(steps)))


def told_apart(bad: np.ndarray, at: np.ndarray, bucket: np.ndarray, own: np.ndarray):
    """Of each bucket: its share of the toxic documents and of the others among ``own``,
    whether it speaks for toxic ones, and whether for either."""
    n_bad, n_good = (bad & own).sum(), (~bad & own).sum()
    in_bad = np.bincount(bucket[(bad & own)[at]], minlength=BUCKETS)
    in_good = np.bincount(bucket[(~bad & own)[at]], minlength=BUCKETS)
    p, q = (in_bad + 0.5) / (n_bad + 1), (in_good + 0.5) / (n_good + 1)
    if not n_bad or not n_good:
        return p, q, np.zeros(BUCKETS, bool), np.zeros(BUCKETS, bool)
    pooled = (in_bad + in_good + 1) / (n_bad + n_good + 2)
    z = (p - q) / np.sqrt(pooled * (1 - pooled) * (1 / n_bad + 1 / n_good))
    toxic = (z > LEAST_Z) & (in_bad >= LEAST_TOXIC)
    return p, q, toxic, toxic | ((z < -LEAST_Z) & (in_bad + in_good >= LEAST_OTHER))


def fit(docs: DataFrame, labels: DataFrame, sample: int = LABEL_SAMPLE, grade: str | None = None,
        key: str = "doc_id", text: str = "text", toxic: str = "toxic", lang: str = "lang") -> Model:
    """Fits on the texts of the first ``sample`` labelled keys by a hash of the key.

    ``grade`` names a column of grades 0, 1, ...; without it grades are made
    from ``toxic`` as above.  Words get a weight if they tell toxic documents
    apart among all labelled documents or among those of one language (where
    ``docs`` has the column ``lang``; null is one, too), so a language with few
    labels isn't drowned by the others.  With no labels, or labels of one kind only, the
    model has no weights and every score is the share of that kind.
    """
    wanted = (labels.select(F.col(key).alias("_label_key"), F.col(grade or toxic).cast("int").alias("_grade"))
              .where("_label_key IS NOT NULL AND _grade IS NOT NULL")
              .groupBy("_label_key").agg(F.max("_grade").alias("_grade"))
              .orderBy(F.xxhash64("_label_key"), "_label_key").limit(sample))
    language = F.col(f"`{lang}`").cast("string") if lang in docs.columns else F.lit(None).cast("string")
    texts = (docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"),
                         F.coalesce(language, F.lit("")).alias("_lang"))
             .join(F.broadcast(wanted), F.col("_key") == F.col("_label_key")).select("_grade", "text", "_lang"))

    def run(batches):
        for batch in batches:
            for first, n, at, bucket, count in features(batch.column(1)):
                offsets = pa.array(np.searchsorted(at, np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n),
                     pa.ListArray.from_arrays(offsets, pa.array(bucket, pa.int32())),
                     pa.ListArray.from_arrays(offsets, pa.array(count, pa.int32())), batch.column(2).slice(first, n)],
                    names=["grade", "buckets", "counts", "lang"])

    rows = texts.mapInArrow(run, "grade int, buckets array<int>, counts array<int>, lang string").toArrow()
    y = rows["grade"].to_numpy().astype(np.int64)
    lists = rows["buckets"].combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    at = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    bucket = lists.flatten().to_numpy().astype(np.int64)
    count = rows["counts"].combine_chunks().flatten().to_numpy().astype(np.float64)
    if len(np.unique(y)) < 2:
        sure = -20.0 if len(y) and y[0] > 0 else 20.0
        return Model(np.empty(0, np.int64), np.empty(0), np.array([sure]))

    bad, language = y > 0, rows["lang"].to_numpy()
    p, q, toxic_words, telling = told_apart(bad, at, bucket, np.ones(len(y), bool))
    for name in np.unique(language):
        _, _, more, others = told_apart(bad, at, bucket, language == name)
        toxic_words, telling = toxic_words | more, telling | others
    chosen = np.flatnonzero(telling)
    if grade is None:
        marker = toxic_words & (p > MARKER_RATIO * q)
        hits = np.bincount(at, count * marker[bucket], minlength=len(y))
        y = np.where(bad, 1 + np.searchsorted(GRADE_EDGES, hits, "right"), 0)
        y = np.unique(y, return_inverse=True)[1]
    used = np.isin(bucket, chosen)
    weights, thresholds = train(at[used], np.searchsorted(chosen, bucket[used]), np.log1p(count[used]), y,
                                len(chosen), int(y.max()) + 1)
    return Model(chosen, weights, thresholds)


def severity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, grade (most likely), expected_severity, toxic.

    toxic: expected severity of at least ``TOXIC_SEVERITY``.  A null or empty text has no
    words and so the score of the thresholds alone.  Repeated rows each give a
    row; other columns are not read.
    """
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            p = model.probabilities(model.scores(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p.argmax(axis=1).astype(np.int32)),
                 pa.array(mean := p @ np.arange(p.shape[1])), pa.array(mean >= TOXIC_SEVERITY)],
                names=["doc_id", "grade", "expected_severity", "toxic"])

    kind = docs.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, grade int, expected_severity double, toxic boolean")

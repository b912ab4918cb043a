"""Quality rules as a ledger of failure bits.

``measure`` evaluates every measurement once per document, ``ledger`` turns
them into one failure bit per rule.  Policies are versioned sets of rules that
are applied to stored bits, without reading a text again; ablations come from
counts per bit pattern.  Only built-in functions: no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

WINDOW_WORDS = 8

#: (rule, fails if), in bit order; a rule's bit never changes, new ones go to the end.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("repeated_lines", "n_lines > 3 AND 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_words")
#: Policies by version: the rules whose failure rejects a document.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "symbols"),
    "v3-trial": (*BASE, "symbols", "repeated_lines", "short_words", "long_words"),
}
#: The policy in force.  The trial policy also rejects documents labelled good.
CURRENT = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def _window_hashes(words: Column) -> Column:
    """64-bit hash of each 8-word window: neighbours' hashes are joined in steps of 1, 2 and 4."""
    def doubled(h: Column, step: int) -> Column:
        return let(h, lambda x: F.zip_with(
            x, F.slice(x, step + 1, F.greatest(F.size(x) - step, F.lit(0))),
            lambda a, b: F.xxhash64(a, b)))

    h = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        h = doubled(h, step)
    return F.slice(h, 1, F.greatest(F.size(words) - (WINDOW_WORDS - 1), F.lit(0)))


def _covered(windows: Column) -> Column:
    """Words in windows found twice or more: equal hashes stand side by side once sorted
    with their places; each such place covers up to eight words."""
    def repeated(sorted_pairs: Column) -> Column:
        n = F.size(sorted_pairs)
        after = F.slice(sorted_pairs, 2, F.greatest(n, F.lit(1)))
        before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,p:int>")),
                          F.slice(sorted_pairs, 1, F.greatest(n - 1, F.lit(0))))
        with_next = F.zip_with(sorted_pairs, after, lambda x, y: F.struct(
            x["h"].alias("h"), x["p"].alias("p"), x["h"].eqNullSafe(y["h"]).alias("same")))
        marked = F.zip_with(with_next, before, lambda x, y: F.when(
            x["same"] | x["h"].eqNullSafe(y["h"]), x["p"]))
        return F.sort_array(F.array_compact(marked))

    def cover(places: Column) -> Column:
        gaps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))),
                          lambda x, y: F.least(F.lit(WINDOW_WORDS), y - x))  # the last one has no next: 8
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return let(pairs, lambda s: let(repeated(s), cover))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of MEASURES (long); a null text has no words."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.regexp_extract_all(body, F.lit(WORD), 0)
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))

    def of_words(w: Column) -> Column:
        windows = _window_hashes(w)
        repeats = let(windows, lambda h: F.when(
            F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))
        return F.struct(F.size(w).cast("long").alias("n_words"), repeats.alias("n_repeat_words"))

    found = let(words, of_words)
    gaps = F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")
    out = docs.withColumn("_w", found)
    symbols = F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long")
    line = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return out.withColumn("_l", line).select(
        *docs.columns, F.col("_w.n_words").alias("n_words"), F.length(gaps).cast("long").alias("word_chars"),
        symbols.alias("n_symbols"), F.col("_l.dup").alias("n_dup_lines"), F.col("_l.n").alias("n_lines"),
        F.col("_w.n_repeat_words").alias("n_repeat_words"))


def fail_bits() -> Column:
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits + F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0))
    return bits


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def passes(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the measurements, fail_bits.

    A null or empty text has no words and fails ``few_words``.  Repeated rows
    each give a row; other columns are not read, so their names cannot clash.
    """
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return measure(narrow).drop("text").withColumn("fail_bits", fail_bits())


def keep(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy doesn't reject, all columns as they were."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(f"`{text}`").cast("string").alias("text"))
    return measure(rows).withColumn("fail_bits", fail_bits()).where(passes(policy)).select("_row.*")


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects.

    The ledger is first counted by bit pattern, at most 2 ** rules rows.
    """
    counts = (book.select(F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("bits"))
              .groupBy("bits").count())
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit"))
                                for n in POLICIES[policy]]))
    per = counts.select("bits", "count", rules.alias("r")).select("bits", "count", "r.rule", "r.bit")
    return per.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("count")).otherwise(0)).alias("only_this"))

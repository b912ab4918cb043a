"""The operators applied to their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from ..sources.tables import table
from . import (bpe, collocations, decontaminate, divergence, fingerprint, packing, quality, rules, sharding, simhash,
               substring, toxicity, warc)
from .common import documents

SHARDS = 24


def op1_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_sharding_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op3_bpe_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                 public_tokenizers.PATTERN)


def op4_substring_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(documents(spark, sf_dir))


def op5_packing_large_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.PATTERN)


def op6_rules_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.ledger(documents(spark, sf_dir))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~rules.passes("v1")).alias("base_failed"), rules.passes(rules.CURRENT).alias("kept"),
                       "fail_bits")


def op7_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.resample(docs, quality.fit(docs, good))


def op8_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_fingerprint_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edited(documents(spark, sf_dir))


def op10_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), fresh_path(spark, "warc_archives"))


def op11_divergence_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_decontaminate_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_collocations_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_toxicity_ordinal, op2_sharding_label_propagation, op3_bpe_sentencepiece, op4_substring_compact_windows,
    op5_packing_large_items, op6_rules_ledger, op7_quality_resampling, op8_simhash_gray_index,
    op9_fingerprint_bottom_k, op10_warc_zstd, op11_divergence_packed, op12_decontaminate_winnowing,
    op13_collocations_automata)}

ORACLE = {
    "op6_rules_ledger": r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, list_slice(words, i, i + 7) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM base WHERE len(words) >= 8)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
measures AS (
  SELECT b.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id),
bits AS (
  SELECT *, n_words < 20 AS few, 100 * n_repeat_words > 30 * n_words AS repeated,
         100 * n_symbols > 30 * n_words AS symbols,
         n_lines > 3 AND 100 * n_dup_lines > 30 * n_lines AS dup_lines,
         word_chars < 2 * n_words AS short, word_chars > 25 * n_words AS long
  FROM measures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       few OR repeated AS base_failed, NOT (few OR repeated OR symbols) AS kept,
       CAST(few AS BIGINT) + 2 * CAST(repeated AS BIGINT) + 4 * CAST(symbols AS BIGINT)
       + 8 * CAST(dup_lines AS BIGINT) + 16 * CAST(short AS BIGINT) + 32 * CAST(long AS BIGINT) AS fail_bits
FROM bits""",
    "op10_warc_zstd": """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k""",
    "op11_divergence_packed": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (
  SELECT g.lang, g.source, k.term, k.n AS lang_n, count(t.rid) AS n
  FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term
  GROUP BY ALL),
p AS (
  SELECT c.*, 1 + (1000000000 * CAST(c.n + 5 AS HUGEINT)) // (sum(c.n) OVER (PARTITION BY c.lang, c.source) + 5 * v) AS p,
         1 + (1000000000 * CAST(lang_n + 5 AS HUGEINT)) // (l.total + 5 * v) AS q
  FROM counts c JOIN langs l ON c.lang = l.lang),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN p x ON x.lang = g.lang AND x.source = g.source
  LEFT JOIN p y ON y.lang = h.lang AND y.source = h.source AND y.term = x.term
  GROUP BY g.lang, g.source, h.source),
rows AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op12_decontaminate_winnowing": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bm AS (SELECT *, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM bm)),
windows AS (SELECT DISTINCT m, win FROM bw),
dw AS (
  SELECT rid, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
  FROM (SELECT d.rid, d.w, s.m, unnest(range(1, len(d.w) - s.m + 2)) AS i
        FROM d JOIN (SELECT DISTINCT m FROM bm) s ON len(d.w) >= s.m)),
found AS (SELECT rid, dw.m, i, dw.win FROM dw JOIN windows ON dw.m = windows.m AND dw.win = windows.win),
hits AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS place FROM found) GROUP BY rid),
items AS (
  SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids
  FROM (SELECT DISTINCT rid, m, win FROM found) f JOIN bw ON f.m = bw.m AND f.win = bw.win
  WHERE item_id IS NOT NULL GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.rid = hits.rid LEFT JOIN items ON d.rid = items.rid""",
    "op13_collocations_automata": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (
  SELECT row_number() OVER () AS piece_id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT piece_id, lang, unnest(w) AS w1, unnest(range(len(w))) AS i FROM w),
paths AS (
  SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM placed
  WINDOW o AS (PARTITION BY piece_id ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, w1 AS phrase FROM paths
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM paths WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM paths WHERE w3 IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.*, cut, x.f AS l, y.f AS r,
         (1000000 * CAST(a AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM c JOIN (VALUES (1), (2)) cs(cut) ON cut < c.k
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(w, 1, cut), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(w, cut + 1, c.k), ' ')),
best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM cuts),
inside AS (
  SELECT lang, array_to_string(list_slice(w, i, i + 1), ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON b.k = 2 AND b.lang = i.lang AND b.phrase = i.phrase
  WHERE place = 1 AND (most IS NULL OR 100 * most < 50 * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN total t ON r.lang = t.lang WHERE rank <= 2000""",
}

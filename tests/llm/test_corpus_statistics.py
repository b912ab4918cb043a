"""Source divergence, benchmark decontamination and collocations against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tastemap.llm import collocations, decontaminate, divergence
from tastemap.llm.words import runs

from .conftest import LONG, SF, lower

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows(df, *order):
    got = [tuple(r[c] for c in df.columns) for r in df.collect()]
    return sorted(got, key=lambda r: tuple((x is not None, x) for x in r)) if not order else got


# ---- source divergence


def brute_audit(docs, least=30, top=50):
    """docs: (lang, source, text)"""
    n, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        found = TERMS.findall(lower(text or ""))
        groups[lang].add(source)
        n[lang, source].update(found)
        n[lang].update(found)
        held[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in held[lang].items() if d >= least]
        total = {g: sum(n[g][t] for t in kept) for g in [lang, *((lang, s) for s in sources)]}

        def p(g, t):
            return 1 + 10 ** 9 * (n[g][t] + 5) // (total[g] + 5 * len(kept))
        for s in sources:
            pairs = [(sum(abs(p((lang, s), t) - p((lang, o), t)) for t in kept), o) for o in sources - {s}]
            terms = [(p((lang, s), t) - p(lang, t), t) for t in kept
                     if n[lang, s][t] and p((lang, s), t) > p(lang, t)]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:limit])]
    return sorted(out)


def test_audit(spark, docs, odd, none):
    own = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    assert rows(divergence.audit(docs)) == brute_audit(own)
    rng = random.Random(5)
    long = "ß" * 9 + "x" * 40
    made = [(rng.choice(["en", None, "中"]), rng.choice(["a", "B", "é", None]),
             " ".join(rng.choice(["A", "ab1abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", long,
                                  long + "y", "Été", "\U0001f600", "z" * 300]) for _ in range(rng.randrange(12))))
            for _ in range(300)]
    made += [("none", "s1", None), ("none", "s2", ""), ("none", "s2", "rare"), ("alone", "s", "x " * 50)]
    df = spark.createDataFrame(made, "lang string, source string, text string").withColumn("n", F.lit("own"))
    assert rows(divergence.audit(df, least_docs=9, top=3)) == brute_audit(made, 9, 3)
    assert ("none", "s1", "pair", "s2", 0, 1) in rows(divergence.audit(df))
    got = rows(divergence.audit(odd, least_docs=1))
    assert got == brute_audit([(r["lang"], r["source"], r["text"]) for r in odd.collect()], 1)
    assert divergence.audit(none).count() == 0


def test_audit_in_buckets_and_blocks(docs, monkeypatch):
    whole = rows(divergence.audit(docs))
    monkeypatch.setattr(divergence, "MATRIX_CELLS", 500)
    monkeypatch.setattr(divergence, "TASK_PAIRS", 50)
    monkeypatch.setattr(divergence, "MAP_TERMS", 3000)
    assert rows(divergence.audit(docs)) == whole


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2 ** 64 - 1), st.sampled_from([0, 1, 2 ** 40])), max_size=60))
def test_radix_order(keys):
    columns = [np.array([k[i] for k in keys], np.uint64) for i in range(3)]
    order = divergence.radix_order(*columns) if keys else np.empty(0, int)
    assert [(keys[i], i) for i in order] == sorted((k, i) for i, k in enumerate(keys))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10 ** 13), st.integers(0, 10 ** 13), st.integers(1, 10 ** 8))
def test_scaled_is_exact(n, more, terms):
    got = divergence.scaled(np.array([n]), np.array([n + more]), terms)[0]
    assert got == 1 + 10 ** 9 * (n + 5) // (n + more + 5 * terms)


# ---- benchmark decontamination


def brute_contamination(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = WORDS.findall(lower(text or ""))
        m = min(window, len(w))
        for i in range(len(w) - m + 1) if m else ():
            windows[tuple(w[i:i + m])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = WORDS.findall(lower(text or ""))
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[tuple(w[i:i + m])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def test_contamination(spark, docs, texts, odd, none):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    got = rows(decontaminate.contamination(docs, bench))
    assert got == brute_contamination(texts.items(), items)
    assert sum(r[-1] for r in got) > 0
    assert rows(decontaminate.contamination(docs, bench.where("false"))) == brute_contamination(texts.items(), [])
    assert decontaminate.contamination(none, bench).count() == 0
    own = [(1, LONG[5000:5300]), (2, "TAB and two"), (3, "été"), (4, None), (5, " .,"), (None, "a b c d"), (7, "one"),
           (7, "one"), (8, "a b c d e f shared0 shared1 shared2 shared3 shared4"), (9, " ".join(["w"] * 30))]
    df = spark.createDataFrame(own, "item_id long, text string").withColumn("size", F.lit("own"))
    odd_texts = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert rows(decontaminate.contamination(odd, df)) == brute_contamination(odd_texts, own)


def test_contamination_of_random_texts(spark):
    rng = random.Random(11)

    def text(n, words):
        return " ".join(rng.choice(words) for _ in range(n))

    few, many = "a b", [f"w{i}" for i in range(60)]
    items = [(i, text(rng.randrange(1, 40), many)) for i in range(60)] + [(100 + i, text(14, few.split())) for i in range(8)]
    docs = []
    for i in range(150):
        parts = [text(rng.randrange(20), many)]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            parts += [" ".join(w[a:a + rng.randrange(1, 15)]).upper(), text(rng.randrange(4), many)]
        docs.append((i, ", ".join(parts)))
    docs += [(200, text(300, few.split())), (201, "a " * 50)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                                      spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == brute_contamination(docs, items)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=10, max_size=14), st.lists(st.sampled_from("abc"), max_size=6),
       st.lists(st.sampled_from("abc"), max_size=6))
def test_a_shared_span_has_a_common_fingerprint(span, before, after):
    one, two = (next(runs(pa.array([" ".join(w)]))) for w in (span, before + span + after))
    found = [set(decontaminate.winnowed(r, r.hashes(), 10)[0].tolist()) for r in (one, two)]
    assert found[0] <= found[1] and found[0]


# ---- collocations


def brute_collocations(docs, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        around = defaultdict(int)
        for p, a in cands.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    around[q] = max(around[q], a)
        found = []
        for p, a in cands.items():
            if len(p) == 2 and 100 * around[p] >= 50 * a and p in around:
                continue
            s, _, l, r = min((10 ** 6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((s, a, " ".join(p), l, r))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


def test_collocations(spark, docs, odd, none):
    own = [(r["lang"], r["text"]) for r in docs.collect()]
    assert rows(collocations.collocations(docs)) == brute_collocations(own)
    found = [(r["lang"], r["text"]) for r in odd.collect()]
    assert rows(collocations.collocations(odd, least=2, top=40)) == brute_collocations(found, 2, 40)
    nameless = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang"] for r in collocations.collocations(nameless, least=2).collect()} == {"und"}
    assert collocations.collocations(none).count() == 0


@pytest.mark.parametrize("held", [50, 4_000_000])
def test_collocations_in_shards_and_ranges(spark, docs, monkeypatch, held):
    """Shards of 700 words, ranges of 2 kB, and a word that a third of all words are."""
    rng = random.Random(3)
    made = [("en", " ".join(rng.choice(["hot", f"v{rng.randrange(9)}", "x. y"]) for _ in range(rng.randrange(900))))
            for _ in range(40)] + [(None, "a b " * 2000)]
    monkeypatch.setattr(collocations, "SHARD_WORDS", 700)
    monkeypatch.setattr(collocations, "RANGE_BYTES", 2000)
    monkeypatch.setattr(collocations, "HELD_PATHS", held)
    df = spark.createDataFrame(made, "lang string, text string").repartition(6)
    assert len(collocations.range_bounds(df.na.fill("und"))) > 10
    assert rows(collocations.collocations(df)) == brute_collocations(made)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(*[st.integers(0, 5)] * 3), min_size=1, max_size=30), min_size=1, max_size=4))
def test_transducer_union(shards):
    words = pa.array(["", "a", "bb", "é", "d", "e"], pa.large_string())
    built, want = [], Counter()
    for shard in shards:
        paths = [np.array(p, np.int64) for p in zip(*shard)]
        built.append(collocations.Transducer.build(
            words, *collocations.added(paths, np.ones(len(shard), np.int64), len(words))))
        want.update(tuple(words[i].as_py() for i in p) for p in shard)
    whole = collocations.Transducer.union([collocations.Transducer.from_bytes(t.to_bytes()) for t in built])
    label = whole.words.to_pylist()
    for depth, (labels, weight) in enumerate(whole.prefix_sums(), 1):
        short = Counter()
        for path, w in want.items():
            short[path[:depth]] += w
        assert dict(zip(zip(*[[label[i] for i in x] for x in labels]), weight.tolist())) == short


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 10 ** 13), st.integers(0, 10 ** 13), st.integers(0, 10 ** 13))
def test_score_terms_are_exact(spark_score, a, more, most):
    spark_score.append((a, a + more, a + most))


@pytest.fixture(scope="module")
def spark_score(spark):
    cases: list[tuple] = []
    yield cases
    df = spark.createDataFrame(cases, "a long, l long, r long")
    for r in df.withColumn("s", collocations.score(F.col("a"), F.col("l"), F.col("r"))).collect():
        assert r["s"] == 10 ** 6 * r["a"] ** 2 // (r["l"] * r["r"])

"""BPE, packing, rules, fingerprints and WARC against plain Python."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tastemap.llm import bpe, fingerprint, packing, rules, warc
from tastemap.llm.words import runs
from tastemap.session import fresh_path

from .conftest import SF, words_of

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
TOKENS = bpe.load_ranks(RANKS)
OTHER = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)},
                          special_tokens={})
CODEC = bpe.Codec(TOKENS, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 'sT1\n\t  é中\U0001f600\x1c\x00.<|")), max_size=40))
def test_codec_is_tiktoken(text):
    ids = CODEC.encode([text])[0]
    assert ids.tolist() == OTHER.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()
    assert CODEC.decimals(ids).decode() == " ".join(map(str, ids.tolist()))


def test_codec_keeps_no_long_text():
    codec = bpe.Codec(TOKENS, P.PATTERN)
    texts = ["word " * 2000, "x" * 5000 + " y", "a  b" * 500, "short one"]
    for _ in range(2):
        for text, ids in zip(texts, codec.encode(texts)):
            assert ids.tolist() == OTHER.encode_ordinary(text)
    assert max(map(len, codec.cache)) <= bpe.CACHED_LENGTH


def test_bpe_rows(docs, texts, odd, none):
    got = bpe.encode_and_decode(docs, RANKS, P.PATTERN).toPandas()
    assert len(got) == len(texts)
    for r in got.itertuples():
        ids = OTHER.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    rows = bpe.encode_and_decode(odd, RANKS, P.PATTERN, with_ids=True).toPandas()
    assert len(rows) == 12 and rows[rows.doc_id == 2].n_tokens.item() == 0
    assert rows[rows.doc_id == 1].ids_sha256.item() == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_and_decode(none, RANKS, P.PATTERN).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_bins_hold_every_piece(histogram):
    classes = packing.plan_bins(histogram, 64)
    assert Counter({n: c for n, c in histogram.items()}) == sum(
        (Counter({n: k * bins for n, k in Counter(lengths).items()}) for lengths, bins in classes), Counter())
    assert all(sum(lengths) <= 64 and sum(3 * n > 64 for n in lengths) <= 2 for lengths, _ in classes)
    runs = sorted(packing.places(classes))
    assert len(set((n, r) for n, r, _, _ in runs)) == len(runs)


def check_packed(rows, texts):
    tokenizer = Tokenizer.from_file(JSON)
    for d, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = rows[rows.doc_id == d].sort_values("piece")
        assert own.start.tolist() == np.concatenate(([0], own.length.cumsum()[:-1])).tolist()
        assert own.length.sum() == len(ids) and (own.length[1:] == 1024).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s:s + n].tobytes()) for s, n in zip(own.start, own.length)]
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.concatenate(([0], own.length.cumsum()[:-1])).tolist()
        assert own.length.sum() <= 1024


def test_packing(docs, texts, odd, none):
    rows = packing.pack_documents(docs, JSON, P.PATTERN).toPandas()
    check_packed(rows, texts)
    assert rows.sequence_id.nunique() <= 1.02 * rows.length.sum() / 1024 + 1
    own = {1: "a <|endoftext|> b", 2: "<|endoftext|>", 3: "<|endoftext |> \u4e2d<|endoftext|>"}
    special = packing.pack_documents(docs.sparkSession.createDataFrame(list(own.items()), "doc_id long, text string"),
                                     JSON, P.PATTERN).toPandas()
    check_packed(special, own)
    assert special[special.doc_id == 2].length.item() == 2
    slow = packing.pack_documents(docs.limit(20), JSON).toPandas()   # tokenizers for every text
    check_packed(slow, {d: texts[d] for d in slow.doc_id.unique()})
    rows = packing.pack_documents(odd, JSON, P.PATTERN).toPandas()
    assert rows[rows.doc_id == 2].length.tolist() == [1] and (rows.doc_id == 6).sum() == 2
    assert rows.doc_id.isna().sum() == 2 and rows[rows.doc_id == 3].piece.max() > 50
    assert packing.pack_documents(none, JSON, P.PATTERN).count() == 0


def measures(text):
    w = words_of(text)
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(lines), len(covered))


def test_rules_measurements(docs, texts, odd, none):
    for r in rules.ledger(docs).collect():
        assert tuple(r[c] for c in rules.MEASURES) == measures(texts[r["doc_id"]])
    book = rules.ledger(odd)
    for r, t in zip(book.collect(), odd.select("text").collect()):
        assert tuple(r[c] for c in rules.MEASURES) == measures(t["text"])
    assert book.columns == ["doc_id", *rules.MEASURES, "fail_bits"]
    assert rules.ledger(none).count() == 0


def test_rules_policies_and_ablations(docs, odd):
    book = rules.ledger(docs).toPandas()
    for policy, names in rules.POLICIES.items():
        mask = rules.mask(policy)
        want = {n: (int((book.fail_bits & rules.BIT[n] > 0).sum()), int((book.fail_bits & mask == rules.BIT[n]).sum()))
                for n in names}
        got = {r["rule"]: (r["fails"], r["only_this"]) for r in rules.ablations(rules.ledger(docs), policy).collect()}
        assert got == want
    kept = rules.keep(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {3, 4, 5, None}
    assert all(r["n_words"] == "own n_words" for r in kept.collect())


def test_rules_are_native(docs):
    plan = rules.keep(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(docs, texts, odd, none):
    rows = fingerprint.with_edited(docs).toPandas().set_index("doc_id")
    order = sorted(texts, reverse=True)
    errors = []
    for d, nxt in zip(order, order[1:] + order[:1]):
        text, n = texts[d], len(texts[d])
        edited = text[:n - n // 3] + texts[nxt][:n // 3]
        r = rows.loc[d]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        errors.append(abs(r.near_edited - likeness(shingles(text), shingles(edited))))
        assert abs(r.near_next - likeness(shingles(text), shingles(texts[nxt]))) < 0.3
    assert max(errors) < 0.3 and np.mean(errors) < 0.06
    rows = fingerprint.with_edited(odd).toPandas()
    assert len(rows) == 12 and rows[rows.doc_id == 4].fingerprint.item() == rows[rows.doc_id == 5].fingerprint.item()
    assert set(rows[rows.doc_id.isin([1, 2, 8])].fingerprint) == {""}
    assert rows[rows.doc_id == 6].nunique().max() == 1
    assert fingerprint.with_edited(none).count() == 0
    one = fingerprint.with_edited(docs.where("doc_id = 3")).first()
    assert one["near_next"] == 1.0


def test_sketch_estimates(spark):
    def text(lo, hi):
        return " ".join(f"t{i}" for i in range(lo, hi))
    df = spark.createDataFrame([(text(0, 9004), text(3000, 12004), text(0, 12004))], "a string, b string, c string")
    a, b, c = (fingerprint.sketch(F.col(x), 256) for x in "abc")
    r = df.select((fingerprint.merge(a, b, 256) == c).alias("m"), fingerprint.resemblance(a, b, 256).alias("r"),
                  fingerprint.containment(a, c, 256).alias("in"), fingerprint.distinct_count(a, 256).alias("n")).first()
    assert r["m"] and abs(r["r"] - 0.5) < 0.1 and r["in"] > 0.85 and abs(r["n"] / 9000 - 1) < 0.25


PAGES = [(1, "http://a", "x" * 1000), (2, "http://b", "x" * 1000), (9, None, "x" * 1000), (3, "c\r\nX: y", "short"),
         (4, "d", "short"), (5, "e", None), (6, "f", ""), (7, "g", "\r\n\r\nWARC/1.1\r\né"), (None, "h", "x" * 1000),
         (8, "i", "y" * 3_000_000), (4, "d", "short")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "own") for p in PAGES], "page_id long, url string, html string, digest string")
    got = warc.round_trip(pages, fresh_path(spark, "warc_test")).toPandas()
    assert len(got) == len(PAGES)
    by = {r.page_id: r for r in got.itertuples()}
    for page, _, html in PAGES:
        if page is not None:
            body = (html or "").encode()
            r = by[page]
            assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
            assert r.record_type == ("revisit" if page in (1, 2) else "response")
    assert by[1].refers_to == by[2].refers_to == 9
    assert warc.round_trip(pages.where("false"), fresh_path(spark, "warc_test")).count() == 0


def test_warc_payloads_and_damage(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = fresh_path(spark, "warc_test")
    warc.write_archives(warc.plan_records(pages), folder).collect()
    files = spark.read.format("binaryFile").load(folder)
    records = warc.read_archives(files, with_payload=True).where("page_id = 7").first()
    assert bytes(records["payload"]).decode() == PAGES[7][2]
    content = bytes(files.first()["content"])
    for bad in (content[:-3], b"\0" + content[1:], content[:len(content) // 2] + b"\1" + content[len(content) // 2 + 1:]):
        with pytest.raises(warc.DamagedArchive):
            [warc.parse_record(x) for x in warc.read_archive(bad)]
    broken = spark.createDataFrame([("p", bytearray(content[:-3]))], "path string, content binary")
    with pytest.raises(PySparkException):
        warc.read_archives(broken).collect()
    record = warc.build_record(1, "u", b"payload", None, False, "2024-01-01T00:00:00Z")
    for bad in (record.replace(b"payload", b"pay1oad"), record.replace(b"WARC/1.1", b"HTTP/1.1"),
                record.replace(b"WARC-Date", b"X-Date"), record[:-1]):
        with pytest.raises(warc.DamagedArchive):
            warc.parse_record(bad)


def test_registered_queries_have_the_contract_columns(spark):
    from tastemap.llm.queries import QUERIES
    want = {
        "op2_sharding_label_propagation": ["doc_id bigint", "size bigint", "text_crc32 bigint", "law string", "shard int",
                                           "slot bigint", "grown_shard int"],
        "op3_bpe_sentencepiece": ["doc_id bigint", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"],
        "op5_packing_large_items": ["doc_id bigint", "piece int", "start bigint", "length bigint", "ids_crc32 bigint",
                                    "sequence_id bigint", "offset bigint"],
        "op8_simhash_gray_index": ["doc_id bigint", "fingerprint string", "component_id bigint"],
        "op10_warc_zstd": ["page_id bigint", "payload_bytes bigint", "payload_digest string", "record_type string",
                           "refers_to bigint"]}
    for name, columns in want.items():
        assert [f"{c} {t}" for c, t in QUERIES[name](spark, SF).dtypes][:len(columns)] == columns


def test_model_bytes_are_the_ranks():
    assert base64.b64encode(TOKENS[0]) and len(TOKENS) == 50256
    assert CODEC.processor.get_piece_size() == len(TOKENS) + 1


def test_words_are_trimmed_whatever_the_run_of_marks():
    texts = ["", "!" * 5000, f"{'-' * 300}ab{'.' * 300} c", "é! (x,y)", "...", "z"]
    run, = runs(pa.array(texts))
    run.trimmed()
    got = [bytes(run.data[a:b]).decode() for a, b in zip(run.start, run.end)]
    assert got == ["ab", "c", "é", "x,y", "z"] and run.text.tolist() == [2, 2, 3, 3, 5]


def test_archive_frames_longer_and_shorter_than_a_feed():
    rng = np.random.default_rng(3)
    records = [rng.bytes(n) for n in (1, 0, 200_000, 5, warc.FEED_BYTES, 70_000)] + [b"same " * 90] * 200
    content = warc.write_archive(records)
    assert list(warc.read_archive(content)) == records
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_archive(content[:-3]))

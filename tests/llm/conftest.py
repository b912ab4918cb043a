import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
SF_LABELS = "/root/testdata/sf0.1"
LONG = " ".join(f"w{i % 977}x{i % 89}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(70))
#: Columns the operators use inside, here with values of the caller's own.
EXTRA = ("fp", "h", "g", "shard", "slot", "position", "log_weight", "sample_key", "n_ngrams", "piece", "length",
         "doc", "spans", "value", "node", "root", "n_words", "fail_bits", "_row", "_cuts", "_identity", "_key", "_pid")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(1, ""), (2, None), (3, LONG), (4, "a b c d e f " + PASSAGE), (5, "a b c d e f " + PASSAGE),
            (6, "Tab\tand  two blanks \n\n end  "), (6, "Tab\tand  two blanks \n\n end  "), (7, "été \U0001f600 中文"),
            (None, "no key " + PASSAGE), (None, None), (8, " \t\n"), (9, "one")]
    df = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in EXTRA])


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")

"""The driver contract, and every registered query against its SQL at sf0.001."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
NO_ORACLE = {"als_recommend_top10", "als_similar_top10"}


def core(names):
    """The queries of the library itself, without the training-data operators."""
    return {k for k in names if k != "pipeline" and not re.match(r"op\d+_", k)}



def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else f"{round(v, 6):.6f}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    return str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(norm(r[c]) for c in cols) for r in pdf.to_dict("records"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["user_key", "rank", "item_id", "title", "predicted_score",
                          "average_rating", "num_ratings"]


def test_every_query_has_oracle_or_is_listed():
    assert core(E.queries()) - set(E.oracle_sql()) == NO_ORACLE
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_query_matches_sql(spark, duck, key):
    got = rows(E.queries()[key](spark, SF_SMALL).toPandas())
    want = rows(duck.execute(E.oracle_sql()[key]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_als_similar_properties(spark):
    df = E.queries()["als_similar_top10"](spark, SF_SMALL).toPandas()
    assert len(df) > 0
    assert (df.src_id != df.item_id).all()
    assert df.similarity.abs().max() <= 1 + 1e-9
    for _, g in df.groupby("src_id"):
        assert list(g.sort_values("rank").similarity) == sorted(g.similarity, reverse=True)
        assert g["rank"].max() <= 10 and g["rank"].is_unique

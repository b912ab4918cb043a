import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tastemap.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", **{"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()


@pytest.fixture
def tmp_root(spark):
    """A fresh folder below the session's shared checkpoint root."""
    from tastemap.session import fresh_path
    return fresh_path(spark, "test")

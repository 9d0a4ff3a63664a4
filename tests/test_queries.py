"""Every registered query against its SQL oracle, on the smallest tables."""

from __future__ import annotations

import os
import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect
from logharbor.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_every_operator_is_registered():
    """One key per operator of the inventory."""
    have = {m[0] for m in (re.match(r"[a-z]\d\d", k) for k in queries()) if m}
    groups = {"s": 13, "p": 18, "f": 11, "j": 9, "a": 17, "t": 6, "r": 12, "v": 12, "x": 8, "m": 4, "w": 7}
    assert have >= {f"{g}{i:02d}" for g, n in groups.items() for i in range(1, n + 1)}


def test_flagship(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = queries()[name](spark, SF_DIR).toArrow()
    want = duck.sql(oracle_sql()[name]).to_arrow_table()
    assert compare(got, want) is None

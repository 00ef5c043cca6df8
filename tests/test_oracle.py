"""Every registered query against its DuckDB oracle at sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

from incognita.plans import catalog  # noqa: E402

QUERIES = {name: fn for name, fn in entry.queries().items() if name in catalog.QUERIES}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in catalog.QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_SMALL, verbose=True)
    assert r["ok"], r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["path", "out_path", "study_id", "top_tag", "item", "tag", "keyword", "vr", "value"]

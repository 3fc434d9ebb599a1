"""Every registered query with an SQL twin equals DuckDB on the same tables."""

import os
import sys

import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "scripts"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import compare, duck  # noqa: E402

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(n for n in ORACLE if not n.startswith("op")))
def test_query_matches_sql(spark, con, name):
    ok, n, _, _, msg = compare(spark, con, name, E.queries()[name], ORACLE[name], SF_SMALL)
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 2
    assert {"model", "scenario", "f1", "auc"} <= set(df.columns)

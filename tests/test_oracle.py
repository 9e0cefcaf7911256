"""Every registered query against its SQL equivalent on the smallest tables."""

from __future__ import annotations

import oracle
import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle.contract.queries()))
def test_query_matches_sql(spark, con, name):
    equal, note = oracle.compare(spark, con, name, SF_DIR)
    assert equal, note


def test_every_query_has_sql():
    assert set(oracle.contract.oracle_sql()) <= set(oracle.contract.queries())


def test_entry_runs(spark):
    assert oracle.contract.entry(spark).count() > 0

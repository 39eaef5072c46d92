"""Every registered query against its oracle at the smallest scale."""
from __future__ import annotations

import pytest

import oracle

NAMES = sorted(oracle.entry.queries())


@pytest.fixture(scope="module")
def con(request):
    from conftest import DATA
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, data_dir, name):
    assert oracle.compare(spark, con, name, data_dir) is None


def test_entry_has_rows(spark):
    assert oracle.entry.entry(spark).limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(oracle.entry.oracle_sql()) <= set(NAMES)

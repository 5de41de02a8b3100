"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import check
import pytest

from workload import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, con, name):
    rows, problem, _ = check.compare(spark, con, name, SF)
    assert problem is None, problem
    assert rows >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert QUERIES.keys() <= entry.queries().keys()
    assert ORACLES.items() <= entry.oracle_sql().items()
    more = entry.queries().keys() - QUERIES.keys()  # of the subpackage llm, where it exists
    assert all(name == "pipeline" or name.startswith("op") for name in more)
    assert {"dimension", "power"} <= set(entry.entry(spark).columns)

"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from lineferry.registry import ORACLES as SQL
from lineferry.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, con, name):
    problem, rows, _ = differences(spark, con, SF, QUERIES[name], SQL[name])
    assert problem is None
    assert rows > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_stays_in_the_engine_and_joins_on_keys(spark, name):
    shown = io.StringIO()
    with redirect_stdout(shown):
        QUERIES[name](spark, SF).explain("formatted")
    plan = shown.getvalue()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas",
                "FlatMapGroupsInPandas", "CollectLimit"):
        assert bad not in plan


def test_entry(spark):
    rows = {r.outcome: r.lines for r in entry.entry(spark).collect()}
    assert rows["header_trailer"] == 2
    assert sum(rows.values()) == 1502

"""Every named query against its SQL oracle on the smallest tables, and its plan."""

import pytest
from oracle_compare import compare, oracle_connection

from __spark_entry__ import entry, queries
from commercium.registry import QUERIES
from oracles import ORACLES

# These fit all ten specifications again, as robustness_results does; the command line tool has them.
SLOW = {"robustness_summary", "elasticity_selection", "overall_scenarios_selected", "mart_manifest"}


@pytest.fixture(scope="module")
def connection(root):
    return oracle_connection(root)


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLES)


def test_entry_is_a_query_result(spark):
    assert entry(spark).columns == queries()["price_realization"](spark, "/root/testdata/sf0.001").columns


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_matches_oracle(spark, root, connection, name):
    seen = []

    def recorded(session, folder):
        seen.append(queries()[name](session, folder))
        return seen[-1]

    assert compare(spark, connection, root, recorded, ORACLES[name]) is None
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

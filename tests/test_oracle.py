"""Every query with SQL must agree with it row for row; the others must return rows."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
sys.path.insert(0, ROOT)

from check import compare, connect  # noqa: E402
from textloom.plans.registry import load  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, duck.sql(ORACLES[name]).df()) is None


# Slow estimators that tools/check.py covers.
SLOW = {"m12_one_vs_rest", "m13_stacking", "m22_grid_search", "model_comparison", "m8_sgd_losses",
        "r7_learning_curve", "m10_boosted_trees", "m7_linear_svm"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_returns_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0

"""Every registered query against its oracle, and the shape of its plan."""

import os
import re

import pytest

import __spark_entry__ as entry
from checks.compare import connect, difference
from checks.oracle import ORACLE as ENGINE_ORACLE
from needscope.plans.queries import all_queries

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = all_queries(), ENGINE_ORACLE
IN_CELLS = {"comparables_all", "comparables_all_split", "comparables_fitted"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    with connect(FOLDER) as connection:
        yield connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, ORACLE[name]) is None


def test_entry_registers_every_query():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"kmeans_sweep"}))
def test_no_pairing_of_all_rows(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_python_only_in_the_cell_step(spark):
    for name in sorted(set(QUERIES) - {"kmeans_sweep"}):
        found = re.findall(r"\b(\w*(?:Python|Pandas)\w*)\b", plan(QUERIES[name](spark, FOLDER)))
        assert not found or name in IN_CELLS, (name, found)


HOT_JOINS = (
    "cluster_avg_ben_ratio", "cluster_std_ben_ratio", "ben_ratio_zscore", "is_efficiency_outlier",
    "outlier_classification", "global_overlook_rank", "regional_overlook_rank", "regional_overlook_score",
)


@pytest.mark.parametrize("name", HOT_JOINS)
def test_large_side_stays_where_it_is(spark, name):
    """The settled small side is broadcast, though estimates of large tables are above the limit."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30k")
    try:
        text = plan(QUERIES[name](spark, FOLDER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in text and "hashpartitioning" not in text

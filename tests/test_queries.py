"""Every registered query against its SQL check, and the shape of the plans."""

import tempfile

import pytest
from compare import difference, duck

import __spark_entry__ as contract
from linkloom import queries
from linkloom.fixtures import Fixtures
from linkloom.oracle import all_oracles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.all_queries()))
def test_query_matches_sql(spark, connection, name):
    assert difference(spark, connection, name, SF) is None


def test_every_query_has_a_check():
    assert queries.all_queries().keys() == all_oracles().keys()


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.fixture(scope="module")
def stored(spark):
    return Fixtures(spark, SF).kept_as_tables(tempfile.mkdtemp(), 2)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries.all_queries()))
def test_no_python_and_no_cross_joins(stored, name):
    plan = plan_of(queries.over_views()[name](stored))
    for word in ("PythonUDF", "ArrowEvalPython", "MapInPandas", "CartesianProduct",
                 "BroadcastNestedLoopJoin", "SinglePartition"):
        allowed = word == "SinglePartition" and name.endswith("_summary")
        assert allowed or word not in plan, word


def text_shuffles(spark, df):
    """How many exchanges of the plan carry document texts."""
    execution = df._jdf.queryExecution()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    blocks = execution.explainString(mode).split("\n\n")
    return sum("Exchange\n" in b and "markdown" in b for b in blocks)


@pytest.fixture
def large(spark):
    """Plans as they are when no table is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edges_leave_texts_behind(spark, stored, large):
    edges = queries.link_edges(stored)
    assert plan_of(edges).count("regexp_extract_all(CASE WHEN") == 1
    assert text_shuffles(spark, edges) == 0


@pytest.mark.parametrize("name, moves", [("rewritten_docs", 1), ("published_docs", 2), ("sync_rewritten", 2)])
def test_texts_move_once_and_linking_ones_to_their_wanted_ids(spark, stored, large, name, moves):
    assert text_shuffles(spark, queries.over_views()[name](stored)) == moves


@pytest.mark.parametrize("name", ["published_docs", "sync_rewritten"])
def test_small_sets_of_wanted_ids_move_no_text(spark, stored, name):
    plan = plan_of(queries.over_views()[name](stored))
    wanted = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert wanted and all("BroadcastHashJoin" in line for line in wanted)


@pytest.mark.parametrize("name", ["document_routes", "conversion_plan"])
def test_planning_reads_no_text(stored, name):
    plan = plan_of(queries.over_views()[name](stored))
    assert "markdown#" not in plan and "markdown:string" not in plan

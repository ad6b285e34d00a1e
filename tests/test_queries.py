"""Every registered query against its SQL on the smallest tables, and the driver's entry point."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_point
from check_queries import compare, oracle_connection
from vertexweave import catalog

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry_point_registers_the_catalog():
    assert set(catalog.queries()) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", catalog.queries())
def test_query_matches_sql(spark, connection, name):
    assert compare(spark, connection, SF_DIR, name)[0] == "ok"


def test_entry(spark):
    assert tuple(entry_point.entry(spark).first()) == (150, 11587, pytest.approx(77.246667), 21, 103, 111, 140)


@pytest.mark.parametrize("name", [
    "adjacency_partitioned_both", "adjacency_segments", "evb_k2_hubs", "expand_hop2", "merge_row_segments",
    "positional_to_edges", "value_differences", "weighted_adjacency_segments",
])
def test_query_matches_sql_by_shuffled_joins(spark, connection, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert compare(spark, connection, SF_DIR, name)[0] == "ok"
    finally:
        for setting in (
            "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes",
        ):
            spark.conf.unset(setting)

"""Physical plans: what must, and must not, be in them."""

import re
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from vertexweave import catalog, operators as op, sources as io
from vertexweave.catalog.graphs import g1
from vertexweave.plans.skew import spread_lookup, tiled_join
from vertexweave.plans.storage import clear_scratch, is_stored, stored

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return initial_plan(df).split("== Initial Plan ==")[0]


# One-row totals, and the counts of the files of a positional graph.
SINGLE_TASK = {
    "block_stats", "block_stats_lone", "block_stats_report", "compare_values", "compare_values_inf",
    "compare_two_plans", "max_vertex_id", "positional_counts", "positional_to_edges",
}


@pytest.mark.parametrize("name", catalog.queries())
def test_plan_shape(spark, name):
    plan = initial_plan(catalog.queries()[name](spark, SF_DIR))
    assert not re.search("Python|ArrowEval|NestedLoop|Cartesian", plan)
    assert name in SINGLE_TASK or "Exchange SinglePartition" not in plan


def test_top_k_is_not_a_full_sort(spark):
    plan = initial_plan(op.top_out_degree(g1(spark, SF_DIR, raw=True), 5))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("name", ["adjacency_both", "weighted_adjacency", "neighbor_arrays"])
def test_short_lists_need_no_join(spark, name):
    plan = final_plan(catalog.queries()[name](spark, SF_DIR))
    assert plan.count("FileScan") == 1
    assert "Join" not in plan


@pytest.mark.parametrize("name", ["adjacency_segments", "weighted_adjacency_segments"])
def test_long_lists_read_their_edges_once(spark, name):
    plan = final_plan(catalog.queries()[name](spark, SF_DIR))
    assert len(re.findall(r"FileScan parquet \[l_partkey", plan)) == 1


def test_scan_reads_two_columns(spark):
    plan = initial_plan(op.distinct_neighbors(g1(spark, SF_DIR), 3))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in plan
    assert "PushedFilters: [IsNotNull(l_partkey), IsNotNull(l_suppkey)" in plan


def test_lookup_prunes_folders_and_columns(spark, tmp_path):
    io.write_table(op.partition_members(g1(spark, SF_DIR), 10), str(tmp_path / "members"), part="part")
    members = spark.read.parquet(str(tmp_path / "members"))
    plan = initial_plan(members.where(F.col("part") == 3))
    assert re.search(r"PartitionFilters: \[isnotnull\(part#\d+\), \(part#\d+ = 3\)\]", plan)
    keys = spark.createDataFrame([(3, "x")], "part int, note string").where("note = 'x'")
    assert "left_semi" in initial_plan(op.lookup_members(members, keys, "part")).lower().replace("leftsemi", "left_semi")

    io.write_table(op.adjacency(g1(spark, SF_DIR), 3), str(tmp_path / "adjacency"))
    lists = spark.read.parquet(str(tmp_path / "adjacency"))
    plan = initial_plan(op.lookup_column(lists, keys.withColumnRenamed("part", "vertex"), "in"))
    assert "ReadSchema: struct<vertex:int,in:array<int>>" in plan


def test_nothing_is_broadcast_beyond_the_size_that_spark_allows(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("evb_k2_hubs", "expand_hop2", "merge_row", "adjacency_partitioned_both", "value_differences"):
            assert "BroadcastExchange" not in initial_plan(catalog.queries()[name](spark, SF_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name,exchanges", [
    ("adjacency_both", 2), ("weighted_adjacency", 2), ("neighbor_arrays", 2), ("evb_packed", 1),
    ("merge_partitions", 1), ("vertices_by_out_degree", 1),
])
def test_lists_are_shuffled_once(spark, name, exchanges):
    plan = initial_plan(catalog.queries()[name](spark, SF_DIR)).split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == exchanges


def test_merge_row_spreads_members_before_keys_are_looked_up(spark):
    rows = op.adjacency_long(g1(spark, SF_DIR), 2)
    keys = rows.select("vertex").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        members = rows.select("vertex", "neighbor").distinct()
        plan = initial_plan(spread_lookup(members, keys.withColumn("_asked", F.lit(True)), "vertex", "neighbor"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"hashpartitioning\(vertex#\d+, neighbor#\d+", plan)
    assert re.search(r"hashpartitioning\(vertex#\d+, _tile#\d+", plan)


def test_partitioned_lists_read_their_edges_once(spark):
    edges = stored(g1(spark, SF_DIR))
    dictionary = op.vertices(edges).select("vertex", (F.col("vertex") % 12).alias("part"))
    plan = initial_plan(op.adjacency_partitioned(edges, stored(dictionary), 3, 12))
    assert "src#" not in re.sub(r"FileScan parquet \[src#.*?\n", "", plan, count=1)


def test_positional_lines_stay_where_they_are_read(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part-{i}").write_text("2\n1\n" if i == 0 else "0 1\n")
    plan = initial_plan(io.positional_to_edges(spark, str(tmp_path)))
    assert "FileScan text" in plan and "Exchange hashpartitioning" not in plan and "SinglePartition" not in plan


def test_shared_folder_setting_is_used(spark):
    kept = stored(spark.range(5))
    assert kept.count() == 5
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(f.startswith(f"file:{folder}") or f.startswith(f"file://{folder}") for f in kept.inputFiles())


def test_scratch_is_cleared_on_demand_only(spark, monkeypatch):
    from vertexweave.plans import storage

    monkeypatch.setattr(storage, "_paths", {})
    kept = stored(spark.range(5))
    assert is_stored(kept) and not is_stored(kept.where("id > 1")) and kept.count() == 5
    (path,) = storage._paths[spark.sparkContext.applicationId]
    assert Path(path).exists()
    assert clear_scratch(spark) == 1 and not Path(path).exists() and clear_scratch(spark) == 0


def test_tasks_for_tiles_follow_pairs_not_tiles(spark):
    hub = spark.createDataFrame([(1, i) for i in range(300)], "k int, a int")
    pairs = tiled_join(hub, hub.withColumnRenamed("a", "b"), "k", "a", "b", tile_side=2)
    assert set(re.findall(r"direct_shuffle_partition_id\(_tile#\d+\), (\d+)\)", initial_plan(pairs))) == {"4"}
    few = tiled_join(hub, hub.withColumnRenamed("a", "b"), "k", "a", "b", tile_side=2, pairs_per_task=10, most_tasks=50)
    assert set(re.findall(r"direct_shuffle_partition_id\(_tile#\d+\), (\d+)\)", initial_plan(few))) == {"50"}
    per_task = few.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 300 * 300
    assert max(r["count"] for r in per_task) < 4 * 300 * 300 / 50


def test_files_of_a_positional_graph_do_not_meet_in_one_task(spark, tmp_path):
    from vertexweave.sources.positional import _in_order

    files = spark.createDataFrame([(f"file:/x/part-{i:03d}", i) for i in range(50)], "file string, lines bigint")
    placed = _in_order(files)
    assert rows(placed) == [(f"file:/x/part-{i:03d}", i * (i - 1) // 2) for i in range(50)]
    # What meets are totals of ranges.
    plan = initial_plan(placed).split("== Initial Plan ==")[0]
    assert len(re.findall("Exchange SinglePartition", plan)) == 1
    assert re.search(r"Exchange SinglePartition.*\n(?:.*\n){0,3}?.*HashAggregate\(keys=\[range", plan)

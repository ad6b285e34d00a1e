"""Hot keys: results stay whole, and no task or list gets all of one key."""

import random
from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from vertexweave import catalog, operators as op
from vertexweave.plans.skew import segment_rows, spread_lookup, tiled_join


def test_tiled_join_makes_each_pair_once(spark):
    rng = random.Random(3)
    left = [(0, a) for a in range(60)] + [(rng.randrange(5), 100 + a) for a in range(40)]
    right = [(0, b) for b in range(45)] + [(rng.randrange(5), 100 + b) for b in range(20)]
    one_sided = [(7, a) for a in range(30)], [(7, 0)]
    left, right = left + one_sided[0], right + one_sided[1]
    joined = tiled_join(
        spark.createDataFrame(left, "k int, a int"), spark.createDataFrame(right, "k int, b int"), "k", "a", "b",
        tile_side=4,
    )
    want = sorted((k, a, b) for k, a in left for j, b in right if j == k)
    assert rows(joined.select("k", "a", "b")) == want


def test_tiles_of_a_hub_go_to_many_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hub = spark.createDataFrame([(1, i) for i in range(200)], "k int, a int")
        pairs = tiled_join(hub, hub.withColumnRenamed("a", "b"), "k", "a", "b", tile_side=20)
        per_task = pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["count"] for r in per_task) == 200 * 200
    assert len(per_task) >= 10
    assert max(r["count"] for r in per_task) < 200 * 200 / 4


def test_spread_lookup_keeps_rows_and_finds_entries(spark):
    asked = [(0, i) for i in range(100)] + [(1, 100), (2, 101), (None, 102)]
    table = [(0, "zero"), (1, "one")]
    found = spread_lookup(
        spark.createDataFrame(asked, "k int, i int"), spark.createDataFrame(table, "k int, name string"), "k", "i",
        rows_per_task=8,
    )
    names = dict(table)
    assert Counter(tuple(r) for r in found.select("k", "i", "name").collect()) == Counter(
        (k, i, names.get(k)) for k, i in asked
    )


IDS = sorted({0, 1, 2, 65535, 65536, 65537, 131072, -1, -2, -65536, -65537, -(2**31), 2**31 - 1, *range(70000, 70040)})


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_segments_follow_rank(spark, size):
    data = [(1, i) for i in IDS] + [(2, 5), (2, -5), (3, None)]
    found = segment_rows(spark.createDataFrame(data, "g int, v int"), ["g"], "v", size=size)
    want = [(1, v, n // size) for n, v in enumerate(IDS)] + [(3, None, 0)]
    want += [(2, v, n // size) for n, v in enumerate([-5, 5])]
    assert Counter(map(tuple, found.select("g", "v", "segment").collect())) == Counter(want)


def test_null_item_in_a_long_group(spark):
    data = [(1, None)] + [(1, i) for i in range(10)]
    found = segment_rows(spark.createDataFrame(data, "g int, v int"), ["g"], "v", size=4)
    assert Counter(map(tuple, found.collect())) == Counter(
        [(1, None, 0)] + [(1, i, i // 4) for i in range(10)]
    )


@pytest.mark.parametrize("size", [1, 4, 10, 100000])
def test_copies_are_shared_out(spark, size):
    data = [(1, 0, 25), (1, 1, 1), (1, 70000, 2), (1, None, 9), (2, 4, 3)]
    found = segment_rows(spark.createDataFrame(data, "g int, v int, n bigint"), ["g"], "v", size=size, copies="n")
    filled = defaultdict(Counter)
    for g, v, n, segment in found.collect():
        if v is not None:
            assert n > 0
            filled[g][segment] += n
            filled[g, v][0] += n
    assert {v: filled[1, v][0] for v in (0, 1, 70000)} == {0: 25, 1: 1, 70000: 2}
    for group, total in ((1, 28), (2, 3)):
        full, rest = divmod(total, size)
        assert filled[group] == Counter({s: size for s in range(full)} | ({full: rest} if rest else {}))
    assert any(r.v is None for r in found.collect())


def test_hub_lists_come_in_segments(edge_frame):
    hub = [(0, i) for i in range(1, 251)] + [(i, 0) for i in range(1, 101)] + [(5, 6), (5, 6), (5, 6)]
    edges = edge_frame(hub)
    stored = {(r.vertex, r.segment): r for r in op.adjacency(edges, 3, segment_size=100).collect()}
    assert [len(stored[0, s].out) for s in range(3)] == [100, 100, 50]
    assert stored[0, 0]["in"] == list(range(1, 101)) and stored[0, 1]["in"] == []
    assert stored[0, 0].out + stored[0, 1].out + stored[0, 2].out == list(range(1, 251))
    lines = op.weighted_adjacency(edges, keep_sinks=True, segment_size=2).where("vertex = 5").orderBy("segment")
    assert [r.line for r in lines.collect()] == ["5\t0:1\t6:1", "5\t6:1\t6:1"]
    packed = op.pack_blocks(op.extended_vertex_blocks(edges, 1, 1), segment_size=100).where("anchor = 0")
    assert sorted(len(r.line.split()) for r in packed.collect()) == [151, 301, 301]


def test_string_order_segments(spark):
    ids = [1, 10, 100, 2, 20, 123456, 1234567, 12345, 9, 99999999, -4]
    members = spark.createDataFrame([(0, v, v % 3) for v in ids], "part int, vertex int, out_degree bigint")
    found = op.merge_partitions_with_degree(members, 1, segment_size=3).orderBy("segment").collect()
    want = sorted(f"{v} {v % 3}" for v in ids)
    assert [r.members for r in found] == [" ".join(want[i:i + 3]) for i in range(0, len(want), 3)]


def test_hub_blocks_are_whole(edge_frame):
    edges = [(i, 0) for i in range(1, 61)] + [(0, i) for i in range(100, 150)]
    found = op.extended_vertex_blocks(edge_frame(edges), 1, 2, tile_side=4)
    want = [(i, 0, 1, "I") for i in range(1, 61)]
    want += [(i, j, 2, "B") for i in range(1, 61) for j in range(100, 150)]
    want += [(0, j, 1, "B") for j in range(100, 150)]
    assert rows(found) == sorted(want)


def test_segments_of_a_hub_find_their_part(edge_frame, spark, monkeypatch):
    from vertexweave.operators import store

    monkeypatch.setattr(store, "LISTS_PER_TASK", 2)
    edges = edge_frame([(0, i) for i in range(1, 31)] + [(i, 0) for i in range(1, 6)])
    dictionary = spark.createDataFrame([(i, i % 4) for i in range(31)], "vertex int, part int")
    found = op.adjacency_partitioned(edges, dictionary, 3, 12, segment_size=3).where("vertex = 0").orderBy("segment")
    listed = [(r.key, r.segment, r.out, r["in"]) for r in found.collect()]
    out = [f"{i}-{i % 4}" for i in range(1, 31)]
    back = [str(i) for i in range(1, 6)]
    assert listed == [("00-0", s, out[3 * s:3 * s + 3], back[3 * s:3 * s + 3]) for s in range(10)]


@pytest.mark.parametrize("name", ["evb_k2_hubs_both_whole", "evb_k2_hubs_tiled_whole"])
def test_whole_hub_blocks_both_ways(spark, tmp_path, name):
    # Suppliers 1 and 2 are hubs; only (2, 2) and (35, 3) have ends that agree modulo 16.
    items = [(part, 1) for part in range(20, 32)] + [(part, 2) for part in range(28, 40) if part % 16 != 2]
    items += [(20, 1), (1, 2), (2, 2), (35, 3)]
    spark.createDataFrame(items, "l_partkey int, l_suppkey int").write.parquet(str(tmp_path / "lineitem.parquet"))
    near = defaultdict(set)
    for a, b in items:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = []
    for anchor in near:
        first = near[anchor]
        second = {v for u in first for v in near[u]} - {anchor}
        want += [(anchor, v, 1, "I") for v in first] + [(anchor, v, 2, "B") for v in second - first]
    got = catalog.queries()[name](spark, str(tmp_path)).select("anchor", "vertex", "distance", "type")
    assert rows(got) == sorted(want)

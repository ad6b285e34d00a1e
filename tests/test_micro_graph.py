"""Worked results on a graph of four vertices, for every operator and mode."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from vertexweave import operators as op

PACKED = {
    (1, 1): ["1 2 1 B", "2 3 1 B", "3 1 1 B 4 1 B"],
    (1, 2): ["1 2 1 I 3 2 B", "2 1 2 B 3 1 I 4 2 B", "3 1 1 I 2 2 B 4 1 B"],
    (1, 3): ["1 2 1 I 3 2 I 4 3 B", "2 1 2 I 3 1 I 4 2 B", "3 1 1 I 2 2 I 4 1 B"],
    (2, 1): ["1 3 1 B", "2 1 1 B", "3 2 1 B", "4 3 1 B"],
    (2, 2): ["1 2 2 B 3 1 I", "2 1 1 I 3 2 B", "3 1 2 B 2 1 I", "4 2 2 B 3 1 I"],
    (2, 3): ["1 2 2 I 3 1 I", "2 1 1 I 3 2 I", "3 1 2 I 2 1 I", "4 1 3 B 2 2 I 3 1 I"],
    (3, 1): ["1 2 1 B 3 1 B", "2 1 1 B 3 1 B", "3 1 1 B 2 1 B 4 1 B", "4 3 1 B"],
    (3, 2): ["1 2 1 I 3 1 I 4 2 B", "2 1 1 I 3 1 I 4 2 B", "3 1 1 I 2 1 I 4 1 I", "4 1 2 B 2 2 B 3 1 I"],
    (3, 3): ["1 2 1 I 3 1 I 4 2 I", "2 1 1 I 3 1 I 4 2 I", "3 1 1 I 2 1 I 4 1 I", "4 1 2 I 2 2 I 3 1 I"],
}


@pytest.mark.parametrize("mode,k", PACKED)
def test_packed_blocks(micro, mode, k):
    packed = op.pack_blocks(op.extended_vertex_blocks(micro, mode, k))
    assert [r.line for r in packed.orderBy("anchor").collect()] == PACKED[mode, k]


@pytest.mark.parametrize("mode,lone", [(1, ["4"]), (2, []), (3, [])])
def test_lone_anchors(micro, mode, lone):
    packed = op.pack_blocks(op.extended_vertex_blocks(micro, mode, 1, keep_lone=True))
    assert [r.line for r in packed.orderBy("anchor").collect()] == PACKED[mode, 1] + lone


def test_edges(micro, micro_raw):
    strict = [(1, 2), (1, 2), (2, 3), (3, 1), (3, 4)]
    assert rows(micro) == strict
    assert rows(micro_raw) == strict + [(4, 4)]


def test_neighbors_keep_repeats(micro):
    assert rows(op.neighbors(micro, 1)) == rows(micro)
    assert rows(op.neighbors(micro, 2)) == [(1, 3), (2, 1), (2, 1), (3, 2), (4, 3)]
    assert op.neighbors(micro, 3).count() == 10
    assert rows(op.distinct_neighbors(micro, 1)) == sorted(set(rows(micro)))


def test_literal_hops(micro):
    first = op.vertex_blocks(micro, 1)
    assert rows(first).count((1, 2, 1, "B")) == 2
    second = op.expand_hop(first, micro, 1, 2)
    assert rows(second) == [
        (1, 2, 1, "I"), (1, 3, 2, "B"), (2, 1, 2, "B"), (2, 3, 1, "I"), (2, 4, 2, "B"), (3, 1, 1, "I"), (3, 2, 2, "B"),
    ]
    assert rows(op.expand_hop(second, micro, 1, 3)) == [
        (1, 3, 2, "I"), (1, 4, 3, "B"), (2, 1, 2, "I"), (3, 2, 2, "I"),
    ]


def test_adjacency(micro):
    assert rows(op.adjacency(micro, 3)) == [
        (1, 0, [2], [3]), (2, 0, [3], [1]), (3, 0, [1, 4], [2]), (4, 0, [], [3]),
    ]
    assert rows(op.adjacency(micro, 1)) == [(1, 0, [2]), (2, 0, [3]), (3, 0, [1, 4]), (4, 0, [])]
    assert op.adjacency(micro, 2).columns == ["vertex", "segment", "in"]


def test_adjacency_long(micro):
    assert rows(op.adjacency_long(micro, 1)) == [(1, 2), (2, 3), (3, 1), (3, 4), (4, -1)]
    assert rows(op.adjacency_long(micro, 2)) == [(1, 3), (2, 1), (3, 2), (4, 3)]
    assert rows(op.adjacency_long(micro, 3)) == [
        (1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (3, 4), (4, 3),
    ]


def test_partitions(micro):
    members = op.partition_members(micro, 3)
    assert rows(members) == [(0, 3), (1, 1), (1, 4), (2, 2)]
    with_degree = op.partition_members_with_degree(micro, 3)
    assert rows(with_degree) == [(0, 3, 2), (1, 1, 1), (1, 4, 0), (2, 2, 1)]
    assert rows(op.merge_partitions(members, 3)) == [("newhash0", 0, "3"), ("newhash1", 0, "1 4"), ("newhash2", 0, "2")]
    assert rows(op.merge_partitions_with_degree(with_degree, 3)) == [
        ("newhash0", 0, "3 2"), ("newhash1", 0, "1 1 4 0"), ("newhash2", 0, "2 1"),
    ]
    assert [r[0] for r in rows(op.merge_partitions_range(members, 3))] == ["0-hash", "1-hash", "2-hash"]
    assert [r[0] for r in rows(op.merge_partitions_range(members, 12))] == ["00-hash", "01-hash", "02-hash"]


def test_negative_ids(edge_frame):
    members = op.partition_members(edge_frame([(-7, 2), (5, -3)]), 3)
    assert rows(members) == [(-1, -7), (0, -3), (2, 2), (2, 5)]
    assert rows(op.merge_partitions(members, 3)) == [("newhash0", 0, "-3"), ("newhash2", 0, "2 5")]


def test_merge_row(micro, spark):
    keys = spark.createDataFrame([(3,), (4,), (9,)], "vertex int")
    assert rows(op.merge_row(op.adjacency_long(micro, 1), keys)) == [("new3", 0, "1 4"), ("new4", 0, "-1")]
    stored = spark.createDataFrame([(1, -2), (1, 7), (1, -1), (1, 3)], "vertex int, neighbor int")
    assert rows(op.merge_row(stored, stored.select("vertex"))) == [("new1", 0, "3 7 -2 -1")]


def test_adjacency_partitioned(micro, lines):
    from vertexweave.sources import read_partition_dict

    dictionary = read_partition_dict(lines("1,0", "2,1", "3,0", "4,1"))
    assert rows(op.adjacency_partitioned(micro, dictionary, 1, 12)) == [
        ("00-1", 0, 1, 0, ["2-1"]), ("00-3", 0, 3, 0, ["1-0", "4-1"]), ("01-2", 1, 2, 0, ["3-0"]), ("01-4", 1, 4, 0, []),
    ]
    both = op.adjacency_partitioned(micro, dictionary, 3, 12)
    assert ("00-3", 0, 3, 0, ["1-0", "4-1"], ["2"]) in rows(both)


def test_unmapped_vertex(micro, lines):
    from vertexweave.sources import read_partition_dict

    dictionary = read_partition_dict(lines("1,0", "2,1", "3,0"))
    with pytest.raises(Exception, match="vertex 4 is not in the partition dictionary"):
        op.adjacency_partitioned(micro, dictionary, 1, 12).collect()
    relaxed = rows(op.adjacency_partitioned(micro, dictionary, 1, 12, strict=False))
    assert (None, None, 4, 0, []) in relaxed
    assert ("00-3", 0, 3, 0, ["1-0", "4-null"]) in relaxed


def test_exports(micro):
    assert [r.line for r in op.weighted_adjacency(micro).orderBy("vertex").collect()] == [
        "1\t2:1\t2:1", "2\t3:1", "3\t1:1\t4:1",
    ]
    assert [r.line for r in op.weighted_adjacency(micro, keep_sinks=True).orderBy("vertex").collect()][3:] == ["4"]
    assert rows(op.neighbor_arrays(micro)) == [
        ("1", 0, ["2", "2"]), ("2", 0, ["3"]), ("3", 0, ["1", "4"]), ("4", 0, []),
    ]


def test_statistics(micro, micro_raw):
    stats = op.block_stats(op.extended_vertex_blocks(micro, 1, 2)).first()
    assert tuple(stats) == (3, 8, pytest.approx(8 / 3), 2, 1, 3, 2)
    lone = op.block_stats(op.extended_vertex_blocks(micro, 1, 2, keep_lone=True)).first()
    assert tuple(lone) == (4, 8, 2.0, 0, 4, 3, 2)
    assert [tuple(r) for r in op.top_out_degree(micro_raw, 3).collect()] == [(1, 2), (3, 2), (2, 1)]
    assert rows(op.out_degree_histogram(micro_raw)) == [(1, 2), (2, 2)]
    assert rows(op.vertices_by_out_degree(micro_raw)) == [(1, 0, [2, 4]), (2, 0, [1, 3])]
    assert op.max_vertex_id(micro_raw).first()[0] == 4


def test_empty_graph(edge_frame):
    nothing = edge_frame([])
    assert rows(op.extended_vertex_blocks(nothing, 1, 3, keep_lone=True)) == []
    assert rows(op.block_stats(op.extended_vertex_blocks(nothing, 1, 2))) == []
    assert op.max_vertex_id(nothing).first()[0] == -1
    assert op.max_vertex_id(edge_frame([(-5, -9)])).first()[0] == -1
    assert rows(op.adjacency(nothing, 3)) == []


def test_lookups(micro, spark):
    keys = spark.createDataFrame([(3,), (77,)], "vertex int")
    assert rows(op.lookup_members(op.adjacency_long(micro, 1), keys)) == [(3, 1), (3, 4)]
    assert rows(op.lookup_column(op.adjacency(micro, 3), keys, "out")) == [(3, 1), (3, 4)]
    assert rows(op.lookup_column(op.adjacency(micro, 3), keys, "in")) == [(3, 2)]
    assert rows(op.lookup_column(op.adjacency(micro, 1), keys, "in")) == []


@pytest.mark.parametrize("call", [
    lambda e: op.neighbors(e, 4), lambda e: op.extended_vertex_blocks(e, 1, 0), lambda e: op.partition_members(e, 0),
    lambda e: op.top_out_degree(e, 0), lambda e: op.expand_hop(op.vertex_blocks(e, 1), e, 1, 1),
    lambda e: op.assign_region_uniform(op.vertices(e), 0, 9), lambda e: op.assign_region_uniform(op.vertices(e), 8, 7),
])
def test_rejected_parameters(micro, call):
    with pytest.raises(ValueError):
        call(micro)


def test_regions(spark):
    ids = spark.range(-1, 11).select(F.col("id").cast("int").alias("vertex"))
    found = dict(rows(op.assign_region_uniform(ids, 4, 10)))
    assert [found[i] for i in range(11)] == [0, 0, 1, 1, 2, 2, 3, 3, 3, 3, 3]
    assert found[-1] == 3
    parts = spark.range(-1, 12).select(F.col("id").cast("int").alias("part"))
    by_hash = dict(rows(op.assign_region_hash(parts, 3, 12)))
    assert [by_hash[p] for p in range(12)] == [0] * 4 + [1] * 4 + [2] * 4
    assert by_hash[-1] == 0
    few = dict(rows(op.assign_region_hash(parts.where("part between 0 and 2"), 5, 3)))
    assert few == {0: 0, 1: 1, 2: 2}
    # With bounds of two digits and keys of one, texts decide: 1- < 10- < 11- < 2-.
    by_text = dict(rows(op.assign_region_hash(parts.where("part between 0 and 2"), 12, 3)))
    assert by_text == {0: 0, 1: 1, 2: 4}

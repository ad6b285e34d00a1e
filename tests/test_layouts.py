"""Stored layouts: rows replaced in place, buckets, regions, kept hops, bit sets, and reports of lines left out."""

import random
import re
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from vertexweave import operators as op, sources as io
from vertexweave.operators import blocks
from vertexweave.plans import storage
from vertexweave.plans.skew import tiled_join


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def member_table(spark, path, pairs):
    io.write_table(spark.createDataFrame(pairs, "part int, vertex int"), path, part="part")


def test_members_are_replaced_by_their_packed_rows(spark, tmp_path):
    path = str(tmp_path / "members")
    member_table(spark, path, [(0, 4), (0, 2), (1, 9), (11, 7), (-1, -5)])
    want = [(None, "00-hash", 0, "2 4", 0), (None, "01-hash", 0, "9", 1), (-5, None, None, None, -1), (7, None, None, None, 11)]
    assert rows(op.replace_members(spark, path, 11)) == sorted(want, key=lambda r: tuple((v is not None, v) for v in r))
    # A second call finds nothing to change, and one after more rows came packs them with the others.
    assert len(rows(op.replace_members(spark, path, 11))) == 4
    spark.createDataFrame([(0, 3)], "part int, vertex int").write.mode("append").partitionBy("part").parquet(path)
    assert (None, "00-hash", 0, "2 3 4", 0) in rows(op.replace_members(spark, path, 11))


def test_a_failed_replacement_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "members")
    member_table(spark, path, [(0, 4), (0, 2), (1, 9)])
    broken = spark.createDataFrame([("x y", 1)], "members string, part int")
    broken.write.mode("append").partitionBy("part").parquet(path)
    with pytest.raises(Exception, match="not a 32-bit integer"):
        op.replace_members(spark, path, 2)
    left = spark.read.schema(
        "vertex int, key string, segment int, members string, part int").parquet(path)
    assert rows(left.select("part", "vertex", "members")) == [(0, 2, None), (0, 4, None), (1, None, "x y"), (1, 9, None)]


def test_finished_hops_are_read_not_made(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(40), rng.randrange(40)) for _ in range(60)], "src int, dst int").where("src <> dst")
    hops_dir = str(tmp_path / "hops")
    made = []

    def kept(session, path, make):
        def noted():
            made.append(path.rsplit("/", 1)[1])
            if made[-1] == "hop-3" and made.count("hop-3") == 1:
                raise RuntimeError("the driver is gone")
            return make()

        return storage.committed(session, path, noted)

    monkeypatch.setattr(blocks, "committed", kept)
    with pytest.raises(RuntimeError):
        op.extended_vertex_blocks(edges, 1, 4, hops_dir=hops_dir)
    assert made == ["neighbors", "hop-2", "hop-3"]
    found = op.extended_vertex_blocks(edges, 1, 4, hops_dir=hops_dir)
    assert made == ["neighbors", "hop-2", "hop-3", "hop-3"]
    assert rows(found) == rows(op.extended_vertex_blocks(edges, 1, 4))


def test_a_hop_left_halfway_is_made_again(spark, tmp_path):
    path = tmp_path / "table"
    path.mkdir()
    (path / "part-00000.parquet").write_text("cut short")
    assert storage.committed(spark, str(path), lambda: spark.range(3)).count() == 3
    assert storage.committed(spark, str(path), lambda: spark.range(9)).count() == 3


def test_a_relation_in_buckets_stays_in_place(spark):
    links = spark.createDataFrame([(i % 50, i) for i in range(500)], "vertex int, neighbor int")
    kept = storage.stored_buckets(links, "vertex", 6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frontier = storage.stored(links.select(F.col("neighbor").alias("anchor"), "vertex"))
        pairs = tiled_join(frontier, kept, "vertex", "anchor", "neighbor", buckets=6)
        shape = plan(pairs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall("Exchange", shape)) == 1 and "hashpartitioning(vertex" in shape
    assert pairs.count() == 50 * 10 * 10


def test_hubs_are_kept_out_of_buckets(spark, monkeypatch):
    edges = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 29)]
    frame = spark.createDataFrame(edges, "src int, dst int")
    want = rows(op.extended_vertex_blocks(frame, 3, 3))
    monkeypatch.setattr(blocks, "SEGMENT_SIZE", 5)
    assert rows(op.extended_vertex_blocks(frame, 3, 3)) == want
    cold, hubs = blocks._bucketed(storage.stored(frame.select(F.col("src").alias("vertex"), F.col("dst").alias("neighbor"))), 3)
    assert rows(hubs.select("vertex").distinct()) == [(0,)] and cold.where("vertex = 0").count() == 0


@pytest.mark.parametrize("mode,k", [(1, 1), (3, 2), (2, 3)])
def test_bit_sets_give_the_same_blocks(spark, mode, k):
    rng = random.Random(mode)
    ids = [-(2**31), -70000, -1025, -1024, -1, 0, 1, 63, 64, 1023, 1024, 70000, 2**31 - 1, *range(200, 215)]
    edges = spark.createDataFrame([(rng.choice(ids), rng.choice(ids)) for _ in range(60)], "src int, dst int").where("src <> dst")
    got = op.bitmap_blocks(edges, mode, k, keep_lone=True, tile_side=2)
    assert rows(got) == rows(op.extended_vertex_blocks(edges, mode, k, keep_lone=True))


def test_rejected_lines_are_counted_in_the_same_pass(spark, lines, tmp_path):
    (tmp_path / "edges.txt").write_text("# c\n1 2\n3 3\n1 x\n9 99999999999\n1 2 3\n\n4 5\n  # y\n")
    edges, counted = io.read_edges_reported(spark.read.text(str(tmp_path / "edges.txt")))
    assert plan(edges).count("FileScan") == 1
    assert rows(edges) == [(1, 2), (4, 5)]
    assert rows(io.rejects(spark, counted)) == [
        ("comment", 2), ("edge to itself", 1), ("not a 32-bit integer", 2), ("not two tokens", 2),
    ]
    hops, counted = io.read_hop_rows_reported(lines("! 1 2 1 B", "@ 4", "! 1 2", "7 8", ""))
    assert rows(hops) == [(1, 2, 1, "B"), (4, None, None, None)]
    assert rows(io.rejects(spark, counted)) == [("neither ! nor @", 2), ("wrong number of tokens", 1)]


def test_a_region_is_one_file_and_is_read_alone(spark, tmp_path):
    path = str(tmp_path / "regions")
    placed = op.assign_region_uniform(spark.range(100).selectExpr("cast(id as int) vertex"), 4, 100)
    io.write_regions(placed, path, 4)
    assert all(len(list(folder.glob("*.parquet"))) == 1 for folder in Path(path).glob("region=*"))
    one = spark.read.schema("vertex int, region int").parquet(path).where("region = 2")
    assert re.search(r"PartitionFilters: \[isnotnull\(region#\d+\), \(region#\d+ = 2\)\]", plan(one))
    assert rows(one) == [(v, 2) for v in range(50, 75)]


def scanned(df):
    """Rows that came out of the scan of a plan without shuffles."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numOutputRows").value()


def scattered(spark):
    """Each key in three rows far from each other, and every stretch of rows with keys from everywhere."""
    return spark.range(60_000).selectExpr("cast(id as int) vertex", "pmod(xxhash64(id % 20000), 1000000007) neighbor")


def test_point_reads_skip_row_groups_by_bloom_filters(spark, tmp_path):
    frame = scattered(spark)
    for name, bloom in (("plain", ()), ("bloom", ("neighbor",))):
        io.write_table(frame, str(tmp_path / name), bloom=bloom, row_group_bytes=20_000)
    keys = [r["neighbor"] for r in frame.where("vertex in (7, 11000)").collect()]
    found = {}
    for name in ("plain", "bloom"):
        stored_rows = spark.read.schema(frame.schema).parquet(str(tmp_path / name))
        found[name] = op.read_members(stored_rows, keys, "neighbor")
    want = rows(frame.where(F.col("neighbor").isin(keys)))
    assert len(want) == 6 and rows(found["bloom"]) == rows(found["plain"]) == want
    assert scanned(found["bloom"]) < 0.4 * scanned(found["plain"])


def test_point_reads_take_many_keys_none_and_strangers(spark, tmp_path):
    frame = scattered(spark)
    io.write_table(frame, str(tmp_path / "t"), bloom=("neighbor",), row_group_bytes=20_000)
    table = spark.read.schema(frame.schema).parquet(str(tmp_path / "t"))
    assert rows(op.read_members(table, [])) == []
    assert rows(op.read_members(table, [5, 5, None, -3, 2**40])) == rows(frame.where("vertex = 5"))
    many = list(range(0, 50_000, 50))
    assert rows(op.read_members(table, many)) == rows(frame.where(F.col("vertex").isin(many)))
    assert "Exchange" not in plan(op.read_members(table, many))
    with pytest.raises(ValueError, match="at most"):
        op.read_members(table, range(1001))

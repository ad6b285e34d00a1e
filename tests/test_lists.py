"""Blocks by lists: whole, whatever goes by lists or by pairs, in one round or many, and with little to shuffle."""

import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_blocks_property import model, random_edges

from vertexweave import operators as op
from vertexweave.operators import blocks
from vertexweave.plans import skew
from vertexweave.plans.skew import segment_rows, segmented_lists, tiled_join
from vertexweave.plans.storage import stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("mode,k,most,per_round", [
    (1, 2, 0, 1 << 29), (1, 3, 6, 60), (2, 3, 12, 1 << 29), (3, 2, 15, 300), (1, 4, 1 << 18, 80), (3, 3, 40, 1 << 29),
])
def test_blocks_by_lists_and_by_pairs_in_rounds(edge_frame, monkeypatch, mode, k, most, per_round):
    monkeypatch.setattr(blocks, "MOST_MET", most)
    monkeypatch.setattr(blocks, "MET_PER_ROUND", per_round)
    monkeypatch.setattr(blocks, "MET_PER_TASK", 50)
    edges = random_edges(10 * k + mode)
    want, lone, _ = model(edges, mode, k)
    found = op.extended_vertex_blocks(edge_frame(edges), mode, k, keep_lone=True, tile_side=2)
    got = rows(found)
    assert [r for r in got if r[1] is not None] == want
    assert [r[0] for r in got if r[1] is None] == lone


def test_rounds_are_kept_and_found(edge_frame, spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    edges = edge_frame([(rng.randrange(30), rng.randrange(30)) for _ in range(70)]).where("src <> dst")
    want = rows(op.extended_vertex_blocks(edges, 1, 3))
    monkeypatch.setattr(blocks, "MET_PER_ROUND", 40)
    made = []
    kept = blocks.committed
    monkeypatch.setattr(blocks, "committed", lambda session, path, make: kept(session, path, lambda: made.append(path) or make()))
    for _ in range(2):
        assert rows(op.extended_vertex_blocks(edges, 1, 3, hops_dir=str(tmp_path / "hops"))) == want
    assert len(made) == len(set(made)) > 4


def test_a_hop_shuffles_lists_not_pairs(edge_frame):
    star = [(i, 0) for i in range(1, 200)] + [(0, i) for i in range(200, 400)]
    found = op.extended_vertex_blocks(edge_frame(star), 1, 2)
    shape = plan(found)
    assert re.search(r"Exchange hashpartitioning\(anchor#\d+, \d+\)", shape)
    assert not re.search(r"Exchange hashpartitioning\(anchor#\d+, vertex#\d+", shape)
    assert found.count() == 199 + 200 + 199 * 200


def test_shuffles_of_stored_tables_do_not_stay(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for name in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name and name.endswith(".data")}

    before = shuffled()
    kept = stored(spark.range(1000).repartition(3, F.col("id")))
    assert shuffled() <= before
    assert kept.count() == 1000


@pytest.mark.parametrize("mode,k", [(1, 3), (3, 2)])
def test_bit_sets_in_rounds(edge_frame, monkeypatch, mode, k):
    monkeypatch.setattr(blocks, "ROWS_PER_ROUND", 400)
    edges = random_edges(mode + k)
    want, lone, _ = model(edges, mode, k)
    got = rows(op.bitmap_blocks(edge_frame(edges), mode, k, keep_lone=True))
    assert [r for r in got if r[1] is not None] == want
    assert [r[0] for r in got if r[1] is None] == lone


def test_last_bits_are_not_looked_up(edge_frame):
    shape = plan(op.bitmap_blocks(edge_frame([(1, 2), (2, 3), (3, 4)]), 3, 1))
    assert "_degree" not in shape and "lambdafunction" not in shape


def test_small_tiles_do_not_multiply_rows(spark):
    hub = stored(spark.range(1200).selectExpr("1 k", "cast(id as int) a"))
    pairs = tiled_join(hub, hub.withColumnRenamed("a", "b"), "k", "a", "b", tile_side=2)
    assert pairs.count() == 1200 * 1200
    sent = re.findall(r"explode\(sequence\(", plan(pairs))
    assert sent
    # 4 tasks of 8 tiles: the rows of a side go to 6 tiles, not to 600.
    left = spark.read.parquet(*[f for f in pairs.inputFiles() if "_first" in spark.read.parquet(f).columns])
    assert left.count() == 1 and left.first()["_r"] <= 8


@pytest.mark.parametrize("whole", [1 << 18, 30])
def test_segments_of_whole_and_of_huge_groups(spark, monkeypatch, whole):
    monkeypatch.setattr(skew, "RANKED_WHOLE", whole)
    data = [(g, v * 7 - 50, 1 + v % 3) for g, n in ((1, 5), (2, 20), (3, 90)) for v in range(n)] + [(4, None, 9), (3, None, 2)]
    frame = spark.createDataFrame(data, "g int, v int, c bigint")
    lists = segmented_lists(frame, ["g"], ["g"], "v", [F.sort_array(F.collect_list("v")).alias("l")], size=8)
    want = []
    for g in (1, 2, 3, 4):
        ids = sorted(v for h, v, _ in data if h == g and v is not None)
        want += [(g, i // 8, ids[i:i + 8]) for i in range(0, max(1, len(ids)), 8)]
    assert rows(lists) == want
    if whole > 30:
        assert plan(lists).split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
    shared = segment_rows(frame, ["g"], "v", size=8, copies="c").groupBy("g", "segment").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))).alias("c"))
    for g, n in ((1, 9), (2, 39), (3, 180)):
        full, rest = divmod(n, 8)
        filled = [r["c"] for r in shared.where(f"g = {g}").orderBy("segment").collect()]
        assert filled == [8] * full + ([rest] if rest else [])


def test_repeats_of_the_first_side_are_not_shuffled_apart(spark):
    first = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", None), ("b", None), ("c", "3")], "vertex string, value string")
    second = spark.createDataFrame([("a", "1"), ("b", None), ("c", "4"), ("d", "1")], "vertex string, value string")
    counted = op.compare_values(first, second)
    assert plan(counted).count("Exchange hashpartitioning") == 2
    assert tuple(counted.first()) == (3, 4, 0, 1, 1, 0, False)

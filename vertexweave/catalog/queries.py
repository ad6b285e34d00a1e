"""One query for each operator, over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vertexweave import operators as op, sources as io
from vertexweave.catalog.graphs import edge_lines, g1, g2, g3, table
from vertexweave.operators.pack import unmerged_members
from vertexweave.plans.storage import scratch_path, stored

Query = Callable[[SparkSession, str], DataFrame]


def _text(column: str) -> Column:
    return F.array_join(column, " ").alias(column)


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("vertex"))


def _part_lines(spark: SparkSession, sf_dir: str, with_regions: bool = True) -> DataFrame:
    """A dictionary for the vertices of G3; the regions are all of its sinks."""
    vertices = op.vertices(g3(spark, sf_dir))
    if not with_regions:
        regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("vertex"))
        vertices = vertices.join(regions, "vertex", "left_anti")
    return vertices.select(F.concat(F.col("vertex"), F.lit(","), F.col("vertex") % 12).alias("value"))


def _partitioned(mode: int, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = io.read_partition_dict(_part_lines(spark, sf_dir))
        lists = op.adjacency_partitioned(g3(spark, sf_dir), parts, mode, 12, **options)
        return lists.select("key", "part", "vertex", "segment", *[_text(c) for c in lists.columns[4:]])

    return query


def _partitioned_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = io.read_partition_dict(_part_lines(spark, sf_dir, with_regions=False))
    lists = op.adjacency_partitioned(g3(spark, sf_dir), parts, 1, 12, strict=False)
    return lists.select("key", "part", "vertex", "segment", _text("out"))


def _dictionary_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select(
        F.concat(F.col("o_custkey"), F.lit(","), F.col("o_orderkey") % 12).alias("value"),
        F.col("o_orderkey").alias("line"),
    )
    return io.read_partition_dict(lines)


def _prepartitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(
        F.col("o_orderkey"), F.lit(","), F.col("o_custkey") % 12, F.lit(","), F.col("o_custkey"), F.lit("\t"),
        F.col("o_orderkey"),
    )
    lines = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" % "), row)).otherwise(row).alias("value")
    )
    return op.load_partitioned_adjacency(lines, 12)


def _positional_path(spark: SparkSession, sf_dir: str) -> str:
    """Orders as vertices, each with the customers of itself and of the next; finished ones have a blank line."""
    orders = table(spark, sf_dir, "orders")
    next_customer = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("next_cust"))
    listed = orders.join(next_customer, "o_orderkey", "left").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "")
        .otherwise(F.concat_ws(" ", F.col("o_custkey"), F.col("next_cust")))
        .alias("line"),
    )
    header = orders.agg(F.lit(-1).cast("bigint").alias("o_orderkey"), F.count(F.lit(1)).cast("string").alias("line"))
    path = scratch_path(spark, "positional")
    io.write_lines(header.unionByName(listed), path, order=("o_orderkey",))
    return path


def _plainly_named(spark: SparkSession, path: str) -> str:
    """The same files under names without a digit, in the same order."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(f.getPath().getName() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-"))
    for name in parts:
        letters = name.split("-")[1].translate(str.maketrans("0123456789", "abcdefghij"))
        files.rename(folder.suffix(f"/{name}"), folder.suffix(f"/graph-{letters}.txt"))
    return path


def _region_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = g1(spark, sf_dir)
    top = op.max_vertex_id(edges).first()["max_vertex_id"]
    return op.assign_region_uniform(op.vertices(edges), 8, top)


def _stored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "members")
    io.write_table(op.partition_members_with_degree(g1(spark, sf_dir), 25), path, part="part")
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("part"))
    members = spark.read.schema("vertex int, out_degree bigint, part int").parquet(path)
    return op.lookup_members(members, regions, "part")


def _point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a few suppliers, in a table that is sorted by part."""
    path = scratch_path(spark, "long")
    io.write_table(op.adjacency_long(g1(spark, sf_dir), 1), path, bloom=("neighbor",))
    # One row for each of the regions.
    named = [r["key"] for r in table(spark, sf_dir, "region").selectExpr("cast(r_regionkey * 17 + 1 as int) key").collect()]
    return op.read_members(spark.read.schema("vertex int, neighbor int").parquet(path), named, "neighbor")


def _stored_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "adjacency")
    io.write_table(op.adjacency(g1(spark, sf_dir), 3), path)
    lists = spark.read.schema("vertex int, segment int, out array<int>, in array<int>").parquet(path)
    return op.lookup_column(lists, _suppliers(spark, sf_dir), "in")


def _string_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.adjacency_long(g1(spark, sf_dir), 2).select(F.concat(F.lit("v"), "vertex").alias("name"), "neighbor")
    keys = _suppliers(spark, sf_dir).select(F.concat(F.lit("v"), "vertex").alias("name"))
    return op.merge_row(rows, keys, key="name")


def _packed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of some packed partitions, read back from their text."""
    packed = stored(op.merge_partitions(op.partition_members(g1(spark, sf_dir), 10), 10))
    keys = table(spark, sf_dir, "region").select(F.concat(F.lit("newhash"), F.col("r_regionkey")).alias("key"))
    return op.lookup_column(packed, keys, "members", key="key")


def _partitioned_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming neighbours of nations, by their keys in the partitioned layout."""
    parts = io.read_partition_dict(_part_lines(spark, sf_dir))
    lists = op.adjacency_partitioned(g3(spark, sf_dir), parts, 2, 12)
    nation = (F.col("n_nationkey") + 100).cast("int")
    keys = table(spark, sf_dir, "nation").select(F.format_string("%02d-%d", nation % 12, nation).alias("key"))
    return op.lookup_column(lists, keys, "in", key="key").withColumn("neighbor", F.col("neighbor").cast("int"))


def _prepartitioned_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _suppliers(spark, sf_dir)
    return op.lookup_column(_prepartitioned(spark, sf_dir), keys, "out")


def _prepartitioned_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several lines for a customer; the one of its last order counts."""
    row = F.concat_ws(",", "o_custkey", F.col("o_custkey") % 12, "o_orderkey")
    lines = table(spark, sf_dir, "orders").select(row.alias("value"), F.col("o_orderkey").alias("line"))
    return op.load_partitioned_adjacency(lines, 12)


def _repeated(members: DataFrame) -> DataFrame:
    """Every row twice."""
    return members.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")


def _edges_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "edges")
    io.write_edges(g1(spark, sf_dir), path)
    return io.read_edges(io.read_lines(spark, path))


def _order_values(spark: SparkSession, sf_dir: str, with_infinity: bool) -> DataFrame:
    """Lines ``customer priority`` of orders; a priority of two words makes a line to reject."""
    priority = F.col("o_orderpriority")
    if with_infinity:
        priority = F.when(F.col("o_orderstatus") == "F", "2147483647").otherwise(priority)
    return table(spark, sf_dir, "orders").select(
        F.concat_ws(" ", F.col("o_custkey"), priority).alias("value"), F.col("o_orderkey").alias("line")
    )


def _values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return (
        io.read_vertex_values(_order_values(spark, sf_dir, False)),
        io.read_vertex_values(_order_values(spark, sf_dir, True)),
    )


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = g2(spark, sf_dir)
    first = op.vertex_blocks(edges, 1)
    return op.merge_hops([first, op.expand_hop(first, edges, 1, 2)])


def _two_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances by the literal hops against those of the search."""

    def values(blocks: DataFrame) -> DataFrame:
        return blocks.select(
            F.concat_ws("-", "anchor", "vertex").alias("vertex"), F.concat_ws("", "distance", "type").alias("value")
        )

    return op.compare_values(
        values(_merged(spark, sf_dir)), values(op.extended_vertex_blocks(g2(spark, sf_dir), 1, 2))
    )


def _packed(segment_size: int | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        blocks = stored(op.extended_vertex_blocks(g2(spark, sf_dir), 1, 2))
        return op.pack_blocks(blocks, **({"segment_size": segment_size} if segment_size else {}))

    return query


def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = op.pack_blocks(op.extended_vertex_blocks(g3(spark, sf_dir), 1, 1, keep_lone=True))
    return io.read_blocks(lines.select(F.col("line").alias("value")))


def _hop_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.read_hop_rows(io.hop_lines(op.extended_vertex_blocks(g3(spark, sf_dir), 1, 3, keep_lone=True)))


def _adjacency(mode: int, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lists = op.adjacency(g1(spark, sf_dir), mode, **options)
        return lists.select("vertex", "segment", *[_text(c) for c in lists.columns[2:]])

    return query


def _neighbor_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.neighbor_arrays(g1(spark, sf_dir)).select("vertex", "segment", _text("neighbors"))


def _vertices_by_degree(segment_size: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op.vertices_by_out_degree(g1(spark, sf_dir, raw=True), segment_size).select(
            "out_degree", "segment", _text("vertices")
        )

    return query


def _edge_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, counted = io.read_edges_reported(edge_lines(spark, sf_dir, True))
    stored(edges)
    return io.rejects(spark, counted)


def _hop_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of edges read as hop rows: those of no mark, and marked ones of two tokens or three."""
    lines = edge_lines(spark, sf_dir, True)
    marked = F.when(F.col("value").startswith("#"), F.concat(F.lit("! "), "value")).otherwise(F.col("value"))
    hops, counted = io.read_hop_rows_reported(lines.select(marked.alias("value")))
    stored(hops)
    return io.rejects(spark, counted)


def _members_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "members")
    io.write_table(op.partition_members(g1(spark, sf_dir), 25), path, part="part")
    return op.replace_members(spark, path, 10)


def _resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hops, by a call that finds two of them made."""
    hops_dir = scratch_path(spark, "hops")
    op.extended_vertex_blocks(g2(spark, sf_dir), 1, 3, hops_dir=hops_dir)
    return op.extended_vertex_blocks(g2(spark, sf_dir), 1, 3, hops_dir=hops_dir)


def _region_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = g1(spark, sf_dir)
    top = op.max_vertex_id(edges).first()["max_vertex_id"]
    path = scratch_path(spark, "regions")
    io.write_regions(op.assign_region_uniform(op.vertices(edges), 8, top), path, 8)
    return spark.read.schema("vertex int, region int").parquet(path).where("region = 3")


def queries() -> dict[str, Query]:
    members = lambda s, d: op.partition_members(g1(s, d), 10)
    members_degree = lambda s, d: op.partition_members_with_degree(g1(s, d), 10)
    return {
        # reading
        "edges_strict": lambda s, d: io.read_edges(edge_lines(s, d, True)),
        "edge_rejects": _edge_rejects,
        "hop_rejects": _hop_rejects,
        "edges_raw": lambda s, d: io.read_edges_raw(edge_lines(s, d, False)),
        "edges_file": _edges_file,
        "partition_dict": _dictionary_last_wins,
        "vertex_values": lambda s, d: io.read_vertex_values(_order_values(s, d, False)).drop("line"),
        "rejected_values": lambda s, d: io.rejected_value_lines(_order_values(s, d, False)).select("value"),
        "blocks_roundtrip": _roundtrip,
        "hop_rows_roundtrip": _hop_roundtrip,
        "positional_to_edges": lambda s, d: io.positional_to_edges(s, _positional_path(s, d)),
        "positional_plain_names": lambda s, d: io.positional_to_edges(s, _plainly_named(s, _positional_path(s, d))),
        "positional_counts": lambda s, d: io.positional_counts(s, _positional_path(s, d)),
        # blocks
        "neighbors_out": lambda s, d: op.neighbors(g1(s, d), 1),
        "neighbors_in": lambda s, d: op.neighbors(g1(s, d), 2),
        "neighbors_both": lambda s, d: op.neighbors(g1(s, d), 3),
        "neighbors_distinct": lambda s, d: op.distinct_neighbors(g1(s, d), 1),
        "vertices": lambda s, d: op.vertices(g1(s, d)),
        "lone_vertices": lambda s, d: op.lone_vertices(g1(s, d), 2),
        "vertex_blocks": lambda s, d: op.vertex_blocks(g2(s, d), 1),
        "expand_hop2": lambda s, d: op.expand_hop(op.vertex_blocks(g2(s, d), 1), g2(s, d), 1, 2),
        "expand_hop2_both": lambda s, d: op.expand_hop(op.vertex_blocks(g2(s, d), 3), g2(s, d), 3, 2),
        "expand_hop2_tiled": lambda s, d: op.expand_hop(op.vertex_blocks(g1(s, d), 1), g1(s, d), 3, 2, tile_side=4),
        "expand_hop2_tiled_both": lambda s, d: op.expand_hop(op.vertex_blocks(g2(s, d), 3), g2(s, d), 3, 2, tile_side=4),
        "merge_hops": _merged,
        "evb_k1_both": lambda s, d: op.extended_vertex_blocks(g1(s, d), 3, 1),
        "evb_k2_out": lambda s, d: op.extended_vertex_blocks(g2(s, d), 1, 2),
        "evb_k2_in": lambda s, d: op.extended_vertex_blocks(g2(s, d), 2, 2),
        "evb_k2_both": lambda s, d: op.extended_vertex_blocks(g2(s, d), 3, 2),
        "evb_k2_hubs": lambda s, d: op.extended_vertex_blocks(g1(s, d), 1, 2),
        "evb_k2_hubs_both_whole": lambda s, d: op.extended_vertex_blocks(g1(s, d), 3, 2),
        "evb_k2_hubs_tiled_whole": lambda s, d: op.extended_vertex_blocks(g1(s, d), 3, 2, tile_side=4),
        "evb_k2_hubs_bitmaps": lambda s, d: op.bitmap_blocks(g1(s, d), 3, 2),
        "evb_k3_bitmaps": lambda s, d: op.bitmap_blocks(g2(s, d), 1, 3),
        "evb_k3_bitmaps_lone": lambda s, d: op.bitmap_blocks(g3(s, d), 1, 3, keep_lone=True),
        "evb_k3_resumed": _resumed,
        "evb_k2_in_lone": lambda s, d: op.extended_vertex_blocks(g1(s, d), 2, 2, keep_lone=True),
        "evb_k3_out": lambda s, d: op.extended_vertex_blocks(g2(s, d), 1, 3),
        "evb_k3_sinks": lambda s, d: op.extended_vertex_blocks(g3(s, d), 1, 3),
        "evb_k3_sinks_lone": lambda s, d: op.extended_vertex_blocks(g3(s, d), 1, 3, keep_lone=True),
        "evb_k2_tree_in": lambda s, d: op.extended_vertex_blocks(g3(s, d), 2, 2),
        "evb_packed": _packed(),
        "evb_packed_segments": _packed(50),
        # stored layouts
        "adjacency_out": _adjacency(1),
        "adjacency_in": _adjacency(2),
        "adjacency_both": _adjacency(3),
        "adjacency_segments": _adjacency(3, segment_size=20),
        "adjacency_long_out": lambda s, d: op.adjacency_long(g3(s, d), 1),
        "adjacency_long_in": lambda s, d: op.adjacency_long(g1(s, d), 2),
        "adjacency_long_both": lambda s, d: op.adjacency_long(g1(s, d), 3),
        "partition_members": members,
        "partition_members_degree": members_degree,
        "adjacency_partitioned_out": _partitioned(1),
        "adjacency_partitioned_in": _partitioned(2),
        "adjacency_partitioned_both": _partitioned(3),
        "adjacency_partitioned_unmapped": _partitioned_unmapped,
        "adjacency_partitioned_segments": _partitioned(3, segment_size=7),
        "load_partitioned_adjacency": _prepartitioned,
        "load_partitioned_repeats": _prepartitioned_repeats,
        "merge_row": lambda s, d: op.merge_row(op.adjacency_long(g1(s, d), 2), _suppliers(s, d)),
        "merge_row_segments": lambda s, d: op.merge_row(
            op.adjacency_long(g1(s, d), 2), _suppliers(s, d), segment_size=100
        ),
        "merge_row_no_neighbor": lambda s, d: op.merge_row(
            op.adjacency_long(g3(s, d), 1), op.lone_vertices(g3(s, d), 1)
        ),
        "merge_row_string_key": _string_keyed,
        "merge_partitions": lambda s, d: op.merge_partitions(members(s, d), 10),
        "merge_partitions_repeats": lambda s, d: op.merge_partitions(_repeated(members(s, d)), 10),
        "merge_partitions_degree_repeats": lambda s, d: op.merge_partitions_with_degree(
            _repeated(members_degree(s, d)), 10
        ),
        "merge_partitions_segments": lambda s, d: op.merge_partitions(members(s, d), 10, segment_size=64),
        "merge_partitions_degree": lambda s, d: op.merge_partitions_with_degree(members_degree(s, d), 10),
        "merge_partitions_degree_segments": lambda s, d: op.merge_partitions_with_degree(
            members_degree(s, d), 10, segment_size=64
        ),
        "merge_partitions_range": lambda s, d: op.merge_partitions_range(members(s, d), 10),
        "unmerged_members": lambda s, d: unmerged_members(op.partition_members(g1(s, d), 25), 10),
        "replace_members": _members_replaced,
        "region_uniform": _region_uniform,
        "region_read_back": _region_read_back,
        "region_hash": lambda s, d: op.assign_region_hash(members(s, d), 4, 10),
        "region_hash_sparse": lambda s, d: op.assign_region_hash(op.partition_members(g1(s, d), 7), 12, 7),
        "region_hash_beyond": lambda s, d: op.assign_region_hash(op.partition_members(g1(s, d), 40), 12, 7),
        "lookup_members": lambda s, d: op.lookup_members(op.adjacency_long(g1(s, d), 3), _suppliers(s, d)),
        "lookup_stored_members": _stored_lookup,
        "read_members": _point_read,
        "lookup_column": _stored_column,
        "lookup_packed": _packed_lookup,
        "lookup_partitioned_key": _partitioned_key_lookup,
        "lookup_prepartitioned": _prepartitioned_lookup,
        # exports
        "weighted_adjacency": lambda s, d: op.weighted_adjacency(g1(s, d)),
        "weighted_adjacency_sinks": lambda s, d: op.weighted_adjacency(g3(s, d), keep_sinks=True),
        "weighted_adjacency_segments": lambda s, d: op.weighted_adjacency(g1(s, d), segment_size=10),
        "neighbor_arrays": _neighbor_arrays,
        # statistics
        "block_stats": lambda s, d: op.block_stats(op.extended_vertex_blocks(g2(s, d), 1, 2)),
        "block_stats_lone": lambda s, d: op.block_stats(op.extended_vertex_blocks(g3(s, d), 1, 2, keep_lone=True)),
        "block_stats_report": lambda s, d: io.stats_lines(op.block_stats(op.extended_vertex_blocks(g3(s, d), 1, 1))),
        "top_out_degree": lambda s, d: op.top_out_degree(g1(s, d, raw=True), 5),
        "out_degree_histogram": lambda s, d: op.out_degree_histogram(g1(s, d, raw=True)),
        "vertices_by_out_degree": _vertices_by_degree(100_000),
        "vertices_by_out_degree_segments": _vertices_by_degree(16),
        "max_vertex_id": lambda s, d: op.max_vertex_id(g1(s, d, raw=True)),
        # comparison
        "compare_values": lambda s, d: op.compare_values(*_values(s, d)),
        "compare_values_inf": lambda s, d: op.compare_values(*_values(s, d), infinity=True),
        "compare_two_plans": _two_plans,
        "value_differences": lambda s, d: op.value_differences(*_values(s, d)),
    }

"""Figures about blocks and raw edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vertexweave.plans.skew import SEGMENT_SIZE, segmented_lists


def block_stats(blocks: DataFrame) -> DataFrame:
    """One row on block sizes: count, total, mean, and the least and greatest with their anchors.

    Of anchors with the same size the smallest is named. No blocks, no row.
    """
    sizes = blocks.groupBy("anchor").agg(F.count("vertex").alias("n"))
    id_down = -F.col("anchor").cast("bigint")
    return (
        sizes.agg(
            F.count(F.lit(1)).alias("anchors"),
            F.sum("n").alias("total_entries"),
            F.avg("n").alias("mean_entries"),
            F.min(F.struct("n", "anchor")).alias("_least"),
            F.max(F.struct(F.col("n"), id_down.alias("id_down"))).alias("_most"),
        )
        .where(F.col("anchors") > 0)
        .select(
            "anchors",
            "total_entries",
            "mean_entries",
            F.col("_least.n").alias("min_entries"),
            F.col("_least.anchor").alias("min_anchor"),
            F.col("_most.n").alias("max_entries"),
            (-F.col("_most.id_down")).cast("int").alias("max_anchor"),
        )
    )


def out_degrees(raw_edges: DataFrame) -> DataFrame:
    """``(vertex, out_degree)``, counting repeats and edges to oneself."""
    return raw_edges.groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("out_degree"))


def top_out_degree(raw_edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` vertices with most outgoing edges; the smaller id goes first among equals."""
    if k < 1:
        raise ValueError("k is 1 or more")
    return out_degrees(raw_edges).orderBy(F.col("out_degree").desc(), "vertex").limit(k)


def out_degree_histogram(raw_edges: DataFrame) -> DataFrame:
    """``(out_degree, vertices)``: how many vertices have each degree."""
    return out_degrees(raw_edges).groupBy("out_degree").agg(F.count(F.lit(1)).alias("vertices"))


def vertices_by_out_degree(raw_edges: DataFrame, segment_size: int = SEGMENT_SIZE) -> DataFrame:
    """``(out_degree, segment, vertices ARRAY<INT>)``: the vertices behind the histogram, in order."""
    return segmented_lists(
        out_degrees(raw_edges), ["out_degree"], ["out_degree"], "vertex",
        [F.sort_array(F.collect_list("vertex")).alias("vertices")], size=segment_size,
    )


def max_vertex_id(raw_edges: DataFrame) -> DataFrame:
    """One row with the greatest id of either end, -1 at least."""
    return raw_edges.agg(
        F.greatest(F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)), F.lit(-1)).alias("max_vertex_id")
    )

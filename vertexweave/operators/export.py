"""Graphs in the text and array forms other engines read. Repeated edges stay repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vertexweave.plans.skew import SEGMENT_SIZE, segmented_lists

# Fixed value: the weight written for every edge.
EDGE_WEIGHT = "1"


def weighted_adjacency(edges: DataFrame, keep_sinks: bool = False, segment_size: int = SEGMENT_SIZE) -> DataFrame:
    """``(vertex, segment, line)`` with lines ``v<TAB>n:1<TAB>n:1…`` of outgoing edges.

    ``keep_sinks`` adds the vertices without outgoing edges, as a bare id.
    """
    text = F.concat(F.lit("\t"), F.col("neighbor").cast("string"), F.lit(":" + EDGE_WEIGHT))
    repeated = F.repeat(text, F.col("copies").cast("int")).alias("text")
    return _out_lists(edges, keep_sinks, segment_size, repeated).select(
        "vertex", "segment", F.concat(F.col("vertex").cast("string"), F.array_join("_out.text", "")).alias("line")
    )


def neighbor_arrays(edges: DataFrame, segment_size: int = SEGMENT_SIZE) -> DataFrame:
    """``(vertex STRING, segment, neighbors ARRAY<STRING>)`` of outgoing edges; a sink has an empty array."""
    repeated = F.array_repeat(F.col("neighbor").cast("string"), F.col("copies").cast("int")).alias("texts")
    return _out_lists(edges, True, segment_size, repeated).select(
        F.col("vertex").cast("string").alias("vertex"), "segment", F.flatten("_out.texts").alias("neighbors")
    )


def _out_lists(edges: DataFrame, keep_sinks: bool, segment_size: int, repeated: Column) -> DataFrame:
    """``(vertex, segment, _out)``: for each neighbour in order, ``repeated`` as often as the edge is.

    Until they are in their segment, repeats travel as counts.
    """
    counted = _out_entries(edges, keep_sinks).groupBy("vertex", "neighbor").agg(F.count(F.lit(1)).alias("copies"))
    entry = F.when(F.col("neighbor").isNotNull(), F.struct("neighbor", repeated))
    lengths = edges.groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("_n"))
    return segmented_lists(
        counted, ["vertex"], ["vertex"], "neighbor", [F.sort_array(F.collect_list(entry)).alias("_out")],
        size=segment_size, copies="copies", counts=lengths,
    )


def _out_entries(edges: DataFrame, keep_sinks: bool) -> DataFrame:
    if not keep_sinks:
        return edges.select(F.col("src").alias("vertex"), F.col("dst").alias("neighbor"))
    return edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("vertex"), F.col("dst").alias("neighbor")),
                F.struct(F.col("dst").alias("vertex"), F.lit(None).cast("int").alias("neighbor")),
            )
        )
    )

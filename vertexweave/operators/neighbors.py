"""Who is next to whom, by direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vertexweave.plans.skew import known

OUT, IN, BOTH = 1, 2, 3


def check_mode(mode: int) -> None:
    if mode not in (OUT, IN, BOTH):
        raise ValueError(f"mode is 1 (outgoing), 2 (incoming) or 3 (both), not {mode!r}")


def neighbors(edges: DataFrame, mode: int) -> DataFrame:
    """``(vertex, neighbor)`` along edges (1), against them (2) or both ways (3); repeats are kept."""
    check_mode(mode)
    if mode == OUT:
        return edges.select(F.col("src").alias("vertex"), F.col("dst").alias("neighbor"))
    if mode == IN:
        return edges.select(F.col("dst").alias("vertex"), F.col("src").alias("neighbor"))
    # Both rows come from one pass over the edges; a union would read them twice.
    ways = F.array(_pair("src", "dst"), _pair("dst", "src"))
    return edges.select(F.inline(ways))


def _pair(vertex: str, neighbor: str):
    return F.struct(F.col(vertex).alias("vertex"), F.col(neighbor).alias("neighbor"))


def distinct_neighbors(edges: DataFrame, mode: int) -> DataFrame:
    """The neighbour relation as a set. It shuffles on pairs, so a hub spreads over all tasks."""
    return known(neighbors(edges, mode), ["vertex", "neighbor"]).distinct()


def vertices(edges: DataFrame) -> DataFrame:
    """Every vertex that an edge starts or ends at."""
    return edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()


def lone_vertices(edges: DataFrame, mode: int) -> DataFrame:
    """Vertices of the graph that have no neighbour in this mode."""
    check_mode(mode)
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("vertex"), F.lit(mode != IN).alias("has_neighbor")),
                F.struct(F.col("dst").alias("vertex"), F.lit(mode != OUT).alias("has_neighbor")),
            )
        )
    )
    return (
        ends.groupBy("vertex")
        .agg(F.max("has_neighbor").alias("has_neighbor"))
        .where(~F.col("has_neighbor"))
        .select("vertex")
    )

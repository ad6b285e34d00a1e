"""Stored forms of a graph: one row for each vertex, one for each neighbour, or by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vertexweave.functions.ids import padded, part_of
from vertexweave.functions.text import strict_int, trim_control
from vertexweave.operators.neighbors import BOTH, IN, OUT, check_mode, distinct_neighbors, lone_vertices, vertices
from vertexweave.plans.skew import SEGMENT_SIZE, list_groups, segment_rows, segmented_lists, spread_lookup
from vertexweave.plans.storage import stored

# Long lists of one vertex looked up together in one task.
LISTS_PER_TASK = 1000
# Fixed value: stands for "no neighbour" in the long form.
NO_NEIGHBOR = -1


def adjacency(edges: DataFrame, mode: int, segment_size: int = SEGMENT_SIZE) -> DataFrame:
    """``(vertex, segment, out, in)``: sorted arrays of distinct neighbours, without the side ``mode`` leaves out.

    Every vertex has a row, if only with empty arrays. A hub whose list exceeds
    ``segment_size`` goes on in rows with further segment numbers.
    """
    return segmented_lists(
        _ends(edges, mode).distinct(), ["vertex"], ["vertex", "outgoing"], "neighbor",
        [_list(side, F.col("neighbor")) for side in _names(mode)],
        size=segment_size, counts=_list_bounds(edges, mode),
    )


def _names(mode: int) -> list[str]:
    return {OUT: ["out"], IN: ["in"], BOTH: ["out", "in"]}[mode]


def _list(side: str, entry: Column) -> Column:
    of_side = F.col("outgoing") if side == "out" else ~F.col("outgoing")
    wanted = of_side & F.col("neighbor").isNotNull()
    return F.sort_array(F.collect_list(F.when(wanted, entry))).alias(side)


def _ends(edges: DataFrame, mode: int) -> DataFrame:
    """``(vertex, outgoing, neighbor)`` for the ends of each edge, from one pass over the edges.

    The end that has no list from an edge still gets a row, with a null
    neighbour, so that no vertex has to be joined in afterwards.
    """
    check_mode(mode)
    src, dst, nobody = F.col("src"), F.col("dst"), F.lit(None).cast("int")

    def end(vertex: Column, outgoing: bool, neighbor: Column) -> Column:
        return F.struct(vertex.alias("vertex"), F.lit(outgoing).alias("outgoing"), neighbor.alias("neighbor"))

    ends = {
        OUT: [end(src, True, dst), end(dst, True, nobody)],
        IN: [end(dst, False, src), end(src, False, nobody)],
        BOTH: [end(src, True, dst), end(dst, False, src)],
    }[mode]
    return edges.select(F.inline(F.array(*ends)))


def _segments(edges: DataFrame, mode: int, segment_size: int) -> DataFrame:
    ends = _ends(edges, mode)
    return segment_rows(
        ends.distinct(), ["vertex", "outgoing"], "neighbor", size=segment_size, counts=_list_bounds(edges, mode)
    )


def _list_bounds(edges: DataFrame, mode: int) -> DataFrame:
    """Edges in each list. Repeats count too: a bound that takes no shuffle of the edges."""
    return _ends(edges, mode).groupBy("vertex", "outgoing").agg(F.count("neighbor").alias("_n"))


def adjacency_long(edges: DataFrame, mode: int) -> DataFrame:
    """``(vertex, neighbor)``, one row for each distinct neighbour; -1 where there is none.

    Mode 3 holds neighbours of both directions in one set.
    """
    nbrs = distinct_neighbors(edges, mode)
    if mode == BOTH:
        return nbrs
    return nbrs.unionByName(lone_vertices(edges, mode).withColumn("neighbor", F.lit(NO_NEIGHBOR)))


def _check_parts(n_parts: int) -> None:
    if n_parts < 1:
        raise ValueError("the number of partitions is 1 or more")


def partition_members(edges: DataFrame, n_parts: int) -> DataFrame:
    """``(part, vertex)`` for every vertex, by remainder."""
    _check_parts(n_parts)
    return vertices(edges).select(part_of(F.col("vertex"), n_parts).alias("part"), "vertex")


def partition_members_with_degree(edges: DataFrame, n_parts: int) -> DataFrame:
    """``(part, vertex, out_degree)``; the degree counts distinct neighbours."""
    _check_parts(n_parts)
    return (
        _ends(edges, OUT)
        .distinct()
        .groupBy("vertex")
        .agg(F.count("neighbor").alias("out_degree"))
        .select(part_of(F.col("vertex"), n_parts).alias("part"), "vertex", "out_degree")
    )


def adjacency_partitioned(
    edges: DataFrame,
    dictionary: DataFrame,
    mode: int,
    n_parts: int,
    strict: bool = True,
    segment_size: int = SEGMENT_SIZE,
) -> DataFrame:
    """``(key, part, vertex, segment, out, in)`` with partitions from a dictionary ``(vertex, part)``.

    The key is ``<padded part>-<vertex>``. Outgoing neighbours are written
    ``neighbor-part``, with ``null`` for one the dictionary lacks; incoming
    ones are plain. A vertex the dictionary lacks fails the query, or has a
    null part and key with ``strict=False``.
    """
    # Read for the neighbour counts, with parts and without.
    lists = stored(_segments(edges, mode, segment_size))
    if mode != IN:
        parts = dictionary.select(F.col("vertex").alias("neighbor"), F.col("part").alias("neighbor_part"))
        lists = _with_parts(lists, parts)
        tag = F.concat(F.lit("-"), F.coalesce(F.col("neighbor_part").cast("string"), F.lit("null")))
    plain = F.col("neighbor").cast("string")
    texts = {"in": plain} if mode == IN else {"in": plain, "out": F.concat(plain, tag)}
    packed = list_groups(lists, "vertex", "segment").agg(
        *[_list(side, F.struct("neighbor", texts[side].alias("text"))) for side in _names(mode)]
    )
    part = F.col("part")
    if strict:
        unmapped = F.format_string("vertex %d is not in the partition dictionary", "vertex")
        part = F.coalesce(part, F.raise_error(unmapped).cast("int"))
    # Lists are packed by now: this looks up one entry for each segment of a vertex.
    segments = _list_bounds(edges, mode).groupBy("vertex").agg((F.max("_n") / segment_size).alias("_n"))
    placed = spread_lookup(
        packed, dictionary.select("vertex", "part"), "vertex", "segment", LISTS_PER_TASK, segments
    ).withColumn("part", part)
    return placed.select(
        F.when(F.col("part").isNotNull(), partition_key(F.col("part"), F.col("vertex"), n_parts)).alias("key"),
        "part",
        "vertex",
        "segment",
        *[F.col(f"{side}.text").alias(side) for side in _names(mode)],
    )


def _with_parts(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """Look up the part of each outgoing neighbour; popular neighbours are spread over tasks."""
    tagged = F.col("outgoing") & F.col("neighbor").isNotNull()
    return spread_lookup(lists.where(tagged), parts, "neighbor", "vertex").unionByName(
        lists.where(~tagged), allowMissingColumns=True
    )


def partition_key(part: Column, vertex: Column, n_parts: int) -> Column:
    return F.concat(padded(part, n_parts), F.lit("-"), vertex.cast("string"))


def load_partitioned_adjacency(lines: DataFrame, n_parts: int = 0, strict: bool = True) -> DataFrame:
    """``(key, part, vertex, out)`` from lines ``vertex,part,n1<TAB>n2…``; ``%`` marks comments.

    ``out`` is the neighbour list with blanks for tabs, whole in one row. A
    line without one fails the query, or gives an empty list with
    ``strict=False``. There is one row for each key: the last by a ``line``
    column, if there is one; without it, a key with two different lists fails
    the query.
    """
    fields = F.split("value", ",")
    listed = F.translate(F.get(fields, F.lit(2)), "\t", " ")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no neighbour list: "), F.col("value")))
        listed = F.when(listed != "", listed).otherwise(missing.cast("string"))
    rows = lines.where(~trim_control(F.col("value")).startswith("%")).select(
        strict_int(F.get(fields, F.lit(0))).alias("vertex"),
        strict_int(F.get(fields, F.lit(1))).alias("part"),
        F.coalesce(listed, F.lit("")).alias("out"),
        *[F.col(c) for c in lines.columns if c == "line"],
    )
    if "line" in lines.columns:
        last = F.max_by("out", "line")
    else:
        several = F.raise_error(F.format_string("two neighbour lists, and no order, for vertex %d", "vertex"))
        last = F.when(F.min("out") == F.max("out"), F.max("out")).otherwise(several.cast("string"))
    rows = rows.groupBy("part", "vertex").agg(last.alias("out"))
    return rows.select(partition_key(F.col("part"), F.col("vertex"), n_parts).alias("key"), "part", "vertex", "out")

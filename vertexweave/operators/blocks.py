"""k-hop blocks: around each anchor, the vertices within k hops.

Rows are ``(anchor, vertex, distance, type)``. The type is ``B`` for a border
vertex, from which the block was not extended, and ``I`` for an interior one.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Observation, functions as F

from vertexweave.operators.neighbors import BOTH, check_mode, distinct_neighbors, lone_vertices, neighbors
from vertexweave.plans.skew import (
    MOST_TASKS, SEGMENT_SIZE, TILE_SIDE, known, list_groups, segmented_lists, spread_lookup, tiled_join,
)
from vertexweave.plans.storage import committed, stored, stored_buckets

BORDER, INTERIOR = "B", "I"
# Vertices, repeats and all, that one anchor meets at a hop and that are merged as lists in one row, at most.
MOST_MET = 1 << 18
# Those that travel to the anchors of one task, and those of one round, about: what a round shuffles is deleted when it ends.
MET_PER_TASK = 1 << 23
MET_PER_ROUND = 1 << 29


def vertex_blocks(edges: DataFrame, mode: int) -> DataFrame:
    """Hop 1: each neighbour of each vertex, once for each edge between them."""
    return neighbors(edges, mode).select(
        F.col("vertex").alias("anchor"),
        F.col("neighbor").alias("vertex"),
        F.lit(1).alias("distance"),
        F.lit(BORDER).alias("type"),
    )


def expand_hop(
    hop: DataFrame, edges: DataFrame, mode: int, distance: int, tile_side: int = TILE_SIDE
) -> DataFrame:
    """The rows of the next hop: extend every block over its border vertices.

    A border vertex with neighbours comes out as interior, at its own distance,
    once for each anchor; each neighbour other than the anchor comes out as
    border at ``distance``, once for each border vertex that leads to it.
    Vertices met in earlier hops come again, so the rows are a multiset. Runs
    jobs when called, which store the relation and the border.
    """
    if distance < 2:
        raise ValueError("the first hop is vertex_blocks; expand_hop makes hop 2 and up")
    nbrs = stored(distinct_neighbors(edges, mode))
    border = known(hop, ["anchor", "vertex"]).where(F.col("type") == BORDER).select("anchor", "vertex").distinct()
    border = stored(border)
    degrees = nbrs.groupBy("vertex").agg(F.count(F.lit(1)).alias("degree"))
    expanded = spread_lookup(border, degrees, "vertex", "anchor").where(F.col("degree").isNotNull()).select(
        "anchor", "vertex", F.lit(distance - 1).alias("distance"), F.lit(INTERIOR).alias("type")
    )
    reached = (
        tiled_join(border, nbrs, "vertex", "anchor", "neighbor", tile_side=tile_side)
        .where(F.col("anchor") != F.col("neighbor"))
        .select(
            "anchor",
            F.col("neighbor").alias("vertex"),
            F.lit(distance).alias("distance"),
            F.lit(BORDER).alias("type"),
        )
    )
    return expanded.unionByName(reached)


def merge_hops(hops: Iterable[DataFrame]) -> DataFrame:
    """Hop rows to blocks: the least distance, and border unless some hop extended the vertex."""
    return (
        reduce(DataFrame.unionByName, hops)
        .groupBy("anchor", "vertex")
        .agg(F.min("distance").alias("distance"), F.bool_and(F.col("type") == BORDER).alias("_border"))
        .select("anchor", "vertex", "distance", F.when(F.col("_border"), BORDER).otherwise(INTERIOR).alias("type"))
    )


def extended_vertex_blocks(
    edges: DataFrame, mode: int, k: int, keep_lone: bool = False, tile_side: int = TILE_SIDE, hops_dir: str | None = None
) -> DataFrame:
    """Blocks of every anchor that has a neighbour, up to ``k`` hops.

    The result is that of merging the literal hops, reached without their
    repeats: the distance is the length of a shortest path, and a vertex is
    border when it is ``k`` hops away or has no neighbours to extend to. Each
    hop extends only the vertices that the hop before reached first.

    ``keep_lone`` adds a row of nulls for each vertex without neighbours. Runs
    jobs when called, a few for each hop. A hop that meets more vertices than
    ``MET_PER_ROUND`` is made in rounds of anchors, the last hop too.

    With ``hops_dir``, a folder for one graph and mode, finished hops but a
    last one without rounds are kept there, and a call finds those of an earlier
    one that was cut short, or had a lesser ``k``, and goes on from them.
    """
    check_mode(mode)
    if k < 1:
        raise ValueError("k is the number of hops, 1 or more")
    nbrs = distinct_neighbors(edges, mode)
    if k == 1:
        blocks = _direct_blocks(nbrs)
    elif hops_dir is None:
        blocks = _searched_blocks(stored(nbrs), mode, k, tile_side)
    else:
        kept = committed(edges.sparkSession, f"{hops_dir}/neighbors", lambda: nbrs)
        blocks = _searched_blocks(kept, mode, k, tile_side, hops_dir)
    if keep_lone:
        lone = lone_vertices(edges, mode).select(F.col("vertex").alias("anchor"))
        blocks = blocks.unionByName(lone, allowMissingColumns=True)
    return blocks


def _direct_blocks(nbrs: DataFrame) -> DataFrame:
    return nbrs.select(
        F.col("vertex").alias("anchor"),
        F.col("neighbor").alias("vertex"),
        F.lit(1).alias("distance"),
        F.lit(BORDER).alias("type"),
    )


def _searched_blocks(nbrs: DataFrame, mode: int, k: int, tile_side: int, hops_dir: str | None = None) -> DataFrame:
    """Hop by hop: what an anchor meets first at a hop is what its neighbours met first at the hop before.

    The neighbours' vertices travel to the anchor as lists and are merged there
    in one row. Anchors that meet more than ``MOST_MET`` are searched by pairs.
    """
    links = _marked_links(nbrs, mode)
    if mode != BOTH:
        links = stored(links)
    pairs = links.select(
        F.col("vertex").alias("anchor"), F.col("neighbor").alias("vertex"), F.lit(1).alias("distance"), "open"
    )
    costs, _, heavy = _hop_costs(nbrs.groupBy(F.col("vertex").alias("anchor")).agg(F.count(F.lit(1)).cast("double").alias("_n")))
    hops = [_neighbor_lists(links, costs, heavy)]
    parts, by_pairs = [pairs], None
    for hop in range(2, k + 1):
        sizes = _list_sizes(hops[-1], costs, heavy)
        costs, met, heavy = _hop_costs(
            spread_lookup(nbrs, sizes.withColumnRenamed("anchor", "neighbor"), "neighbor", "vertex")
            .groupBy(F.col("vertex").alias("anchor"))
            .agg(F.sum(F.coalesce("_n", F.lit(0.0))).alias("_n"))
        )
        rounds = max(1, ceil(met / MET_PER_ROUND))
        last, path = hop == k, None if hops_dir is None else f"{hops_dir}/lists/hop-{hop}"

        def found(hop: int = hop, known: list[DataFrame] = [*hops], round: int = 0) -> DataFrame:
            lists = _merged_lists(nbrs, known, sizes, costs, heavy, met, hop, last, rounds, round)
            if round or not heavy:
                return lists
            so_far = _pairs_of_heavy(pairs, parts[1:], costs)
            reached = _paired_hop(so_far, nbrs, links, hop, last, tile_side, by_pairs)
            new = reached.where(F.col("distance") == hop).select("anchor", "vertex", "distance", "open")
            return lists.withColumn("vertex", F.lit(None).cast("int")).unionByName(
                new.withColumn("vertices", F.lit(None).cast("array<int>"))
            )

        if heavy and by_pairs is None:
            by_pairs = (links, None, None)
            if k > 2:
                # Each hop joins with the whole relation, which stays where it is.
                buckets = int(nbrs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
                by_pairs = (*_bucketed(links, buckets), buckets)
        if rounds == 1 and last:
            made = found()
        elif path is None:
            made = _union([stored(found(round=r), lists=True) for r in range(rounds)])
        elif rounds == 1:
            made = committed(nbrs.sparkSession, path, found)
        else:
            # Such a result is kept even of the last hop.
            made = _union([
                committed(nbrs.sparkSession, f"{path}/{r}-of-{rounds}", lambda r=r: found(round=r)) for r in range(rounds)
            ])
        parts.append(made)
        hops.append(_only_lists(made))
    interior = (F.col("distance") < k) & F.col("open")
    return _union([pairs, *map(_as_pairs, parts[1:])]).select(
        "anchor", "vertex", "distance", F.when(interior, INTERIOR).otherwise(BORDER).alias("type")
    )


def _union(tables: list[DataFrame]) -> DataFrame:
    """Of tables that may lack the column of the pairs."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables)


def _hop_costs(costs: DataFrame) -> tuple[DataFrame, float, bool]:
    """How many vertices each anchor meets, repeats and all, as a stored table; their sum over anchors that have lists; whether some have none."""
    made = Observation()
    light = F.col("_n") <= MOST_MET
    costs = stored(costs.observe(
        made, F.sum(F.when(light, F.col("_n"))).alias("met"), F.count(F.when(~light, 1)).alias("heavy")
    ))
    return costs, made.get["met"] or 0.0, bool(made.get["heavy"])


def _light(rows: DataFrame, costs: DataFrame, heavy: bool) -> DataFrame:
    """The rows of anchors that lists are made for."""
    return rows.join(costs.where(F.col("_n") > MOST_MET).select("anchor"), "anchor", "left_anti") if heavy else rows


def _neighbor_lists(links: DataFrame, costs: DataFrame, heavy: bool) -> DataFrame:
    """``(anchor, distance, open, vertices)`` of the first hop: a list for neighbours that lead on, and one for others."""
    rows = _light(links.withColumnRenamed("vertex", "anchor"), costs, heavy)
    sides = (("_on", F.col("open")), ("_end", ~F.col("open")))
    lists = list_groups(rows, "anchor").agg(
        *[F.sort_array(F.collect_list(F.when(which, F.col("neighbor")))).alias(c) for c, which in sides]
    )
    return stored(_list_rows(lists, 1), lists=True)


def _list_rows(lists: DataFrame, distance: int) -> DataFrame:
    """A row for each list that is not empty."""
    both = F.array(*[
        F.struct(F.lit(distance).alias("distance"), F.lit(is_open).alias("open"), F.col(c).alias("vertices"))
        for c, is_open in (("_on", True), ("_end", False))
    ])
    return lists.select("anchor", F.inline(both)).where(F.size("vertices") > 0)


def _list_sizes(lists: DataFrame, costs: DataFrame, heavy: bool) -> DataFrame:
    """``(anchor, _n)``: how much an anchor has for the next hop; anchors without a list have more than any list holds."""
    sizes = lists.groupBy("anchor").agg(F.sum(F.size("vertices")).cast("double").alias("_n"))
    if heavy:
        beyond = costs.where(F.col("_n") > MOST_MET).select("anchor", F.lit(float(MOST_MET + 1)).alias("_n"))
        sizes = sizes.unionByName(beyond)
    return stored(sizes)


def _merged_lists(
    nbrs: DataFrame,
    known: list[DataFrame],
    sizes: DataFrame,
    costs: DataFrame,
    heavy: bool,
    met: float,
    hop: int,
    last: bool,
    rounds: int,
    round: int,
) -> DataFrame:
    """The lists of vertices first met at ``hop``, of the anchors of one round."""
    usual = int(nbrs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(usual, min(MOST_TASKS, ceil(met / rounds / MET_PER_TASK)))

    def chosen(rows: DataFrame) -> DataFrame:
        if rounds > 1:
            rows = rows.where(F.pmod(F.xxhash64("anchor"), F.lit(rounds)) == round)
        return _light(rows, costs, heavy)

    asked = chosen(nbrs.select(F.col("vertex").alias("anchor"), F.col("neighbor").alias("vertex")))
    lists = known[-1].select(F.col("anchor").alias("vertex"), "open", "vertices")
    sent = (
        asked.groupBy("vertex").agg(F.count(F.lit(1)).alias("_asked"))
        .join(sizes.withColumnRenamed("anchor", "vertex"), "vertex")
        .select("vertex", (F.col("_asked") * F.col("_n")).alias("_n"))
    )
    onward = spread_lookup(asked, lists, "vertex", "anchor", rows_per_task=MET_PER_TASK, counts=sent, tasks=tasks)
    rows = reduce(
        DataFrame.unionByName,
        [chosen(x).select("anchor", "distance", "open", "vertices") for x in known],
        onward.where(F.col("vertices").isNotNull()).select("anchor", F.lit(hop).alias("distance"), "open", "vertices"),
    )
    new = F.col("distance") == hop

    def together(which: Column) -> Column:
        return F.flatten(F.collect_list(F.when(which, F.col("vertices"))))

    grouped = rows.repartition(tasks, "anchor").groupBy("anchor").agg(
        F.concat(together(~new), F.array("anchor")).alias("_known"),
        # At the last hop all are border.
        together(new if last else new & F.col("open")).alias("_on"),
        together(F.lit(False) if last else new & ~F.col("open")).alias("_end"),
    )
    fresh = [F.array_except(c, "_known") for c in ("_on", "_end")]
    if not (last and rounds == 1):
        # They are stored, and take less room in order.
        fresh = [F.sort_array(c) for c in fresh]
    return _list_rows(grouped.select("anchor", *[c.alias(name) for name, c in zip(("_on", "_end"), fresh)]), hop)


def _only_lists(made: DataFrame) -> DataFrame:
    return made.select("anchor", "distance", "open", "vertices").where(F.col("vertices").isNotNull())


def _as_pairs(made: DataFrame) -> DataFrame:
    """``(anchor, vertex, distance, open)`` of what a hop found, lists and pairs."""
    if "vertex" not in made.columns:
        return made.select("anchor", F.explode("vertices").alias("vertex"), "distance", "open")
    vertices = F.when(F.col("vertices").isNotNull(), F.col("vertices")).otherwise(F.array("vertex"))
    return made.select("anchor", F.explode(vertices).alias("vertex"), "distance", "open")


def _pairs_of_heavy(pairs: DataFrame, parts: list[DataFrame], costs: DataFrame) -> DataFrame:
    """All that is known so far of the anchors that no lists are made for."""
    anchors = costs.where(F.col("_n") > MOST_MET).select("anchor")
    first, *later = (rows.join(anchors, "anchor", "left_semi") for rows in (pairs, *parts))
    return stored(_union([first, *map(_as_pairs, later)]))


def _paired_hop(
    before: DataFrame,
    nbrs: DataFrame,
    links: DataFrame,
    hop: int,
    last: bool,
    tile_side: int,
    by_pairs: tuple[DataFrame, DataFrame | None, int | None],
) -> DataFrame:
    """``before`` and what one more hop reaches, by pairs; vertices met earlier keep their distance."""
    onward, hubs, buckets = by_pairs
    frontier = before.where((F.col("distance") == hop - 1) & F.col("open")).select("anchor", "vertex")
    if last and buckets is None:
        # Vertices first met in the last hop are border whether they are open or not.
        onward = nbrs.withColumn("open", F.lit(False))
    pairs = tiled_join(frontier, onward, "vertex", "anchor", "neighbor", tile_side=tile_side, buckets=buckets)
    if hubs is not None:
        pairs = pairs.unionByName(tiled_join(frontier, hubs, "vertex", "anchor", "neighbor", tile_side=tile_side))
    met = (
        pairs.where(F.col("anchor") != F.col("neighbor"))
        .select("anchor", F.col("neighbor").alias("vertex"), F.lit(hop).alias("distance"), "open")
    )
    return (
        before.unionByName(met)
        .groupBy("anchor", "vertex")
        .agg(F.min("distance").alias("distance"), F.max("open").alias("open"))
    )


def _bucketed(links: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame | None]:
    """The relation in buckets by vertex, and apart from it that of hubs, which no one task is to hold; None without any."""
    degrees = links.groupBy("vertex").agg(F.count(F.lit(1)).alias("_degree"))
    hubs = stored(degrees.where(F.col("_degree") > SEGMENT_SIZE).select("vertex"))
    if hubs.isEmpty():
        return stored_buckets(links, "vertex", buckets), None
    of_hubs = stored(links.join(hubs, "vertex", "left_semi"))
    return stored_buckets(links.join(hubs, "vertex", "left_anti"), "vertex", buckets), of_hubs


# Anchors that one row has bits for, in words of 64.
WORDS = 4
_WORD_BITS, _BLOCK_BITS = 6, 8
# Rows of bits that a round of a hop makes, about; what a round shuffles is deleted when it ends.
ROWS_PER_ROUND = 1 << 26
# The places of the bits of each octet.
_PLACES = f"array({', '.join(f'array({", ".join(str(i) for i in range(8) if octet >> i & 1)})' for octet in range(256))})"


def bitmap_blocks(edges: DataFrame, mode: int, k: int, keep_lone: bool = False, tile_side: int = TILE_SIDE) -> DataFrame:
    """The result of :func:`extended_vertex_blocks`, found on sets of anchors as bits.

    A row stands for a vertex and 256 anchors with neighbouring ids, and holds
    a bit for each of those that reach the vertex first at this hop. A hop joins
    these rows with the neighbour relation and merges bits by ``or``: where many
    anchors reach the same vertices, that is far less to shuffle than pairs,
    which are only spelled out at the end. On a sparse graph it is more. A hop
    of more than ``ROWS_PER_ROUND`` such rows is made in rounds of blocks.
    """
    check_mode(mode)
    if k < 1:
        raise ValueError("k is the number of hops, 1 or more")
    nbrs = stored(distinct_neighbors(edges, mode))
    bits = [f"w{i}" for i in range(WORDS)]
    anchor = F.col("vertex")
    word, bit = F.shiftright(anchor, _WORD_BITS).bitwiseAND(WORDS - 1), anchor.bitwiseAND((1 << _WORD_BITS) - 1)
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    first = (
        nbrs.select(F.col("neighbor").alias("vertex"), F.shiftright(anchor, _BLOCK_BITS).alias("block"), word.alias("word"), mask.alias("mask"))
        .groupBy("vertex", "block")
        .agg(*[F.coalesce(F.bit_or(F.when(F.col("word") == i, F.col("mask"))), F.lit(0).cast("bigint")).alias(w) for i, w in enumerate(bits)])
    )
    degrees = stored(nbrs.groupBy("vertex").agg(F.count(F.lit(1)).alias("_degree")))
    fresh = [stored(first)]
    seen = fresh[0]
    for hop in range(2, k + 1):
        before, last = fresh[-1], hop == k
        met = before.join(degrees, "vertex").agg(F.sum("_degree")).first()[0] or 0
        rounds = max(1, ceil(met / ROWS_PER_ROUND))

        def merged(round: int) -> DataFrame:
            """Bits that one more hop reaches, and those seen before, of the blocks of one round."""
            old, known_bits = before, seen
            if rounds > 1:
                old, known_bits = (x.where(F.pmod("block", F.lit(rounds)) == round) for x in (old, known_bits))
            met = tiled_join(old, nbrs, "vertex", "block", "neighbor", tile_side=tile_side)
            both = met.select(
                F.col("neighbor").alias("vertex"), "block", *bits, *[F.lit(0).cast("bigint").alias(f"seen_{w}") for w in bits]
            ).unionByName(known_bits.select("vertex", "block", *[F.lit(0).cast("bigint").alias(w) for w in bits], *[F.col(w).alias(f"seen_{w}") for w in bits]))
            found = both.groupBy("vertex", "block").agg(*[F.bit_or(c).alias(c) for w in bits for c in (w, f"seen_{w}")])
            return _new_bits(found, bits) if last else found

        if last:
            fresh.append(merged(0) if rounds == 1 else _union([stored(merged(r)) for r in range(rounds)]))
        else:
            found = _union([stored(merged(r)) for r in range(rounds)])
            fresh.append(_new_bits(found, bits))
            seen = found.select("vertex", "block", *[F.col(w).bitwiseOR(F.col(f"seen_{w}")).alias(w) for w in bits])
    *inner, outer = [rows.withColumn("distance", F.lit(hop)) for hop, rows in enumerate(fresh, 1)]
    typed = [outer.withColumn("type", F.lit(BORDER))]
    if inner:
        # One row for many pairs: whether a vertex leads on is looked up here. At the last hop it does not matter.
        looked_up = spread_lookup(_union(inner), degrees, "vertex", "block")
        typed.append(looked_up.withColumn("type", F.when(F.col("_degree").isNotNull(), INTERIOR).otherwise(BORDER)).drop("_degree"))
    words = F.array(*[F.struct(F.lit(i << _WORD_BITS).alias("word"), F.col(w).alias("bits")) for i, w in enumerate(bits)])
    some = _union(typed).select("vertex", "block", "distance", "type", F.inline(words)).where("bits <> 0")
    octets = F.array(*[
        F.struct(F.lit(i).alias("octet"), F.call_function("shiftright", F.col("bits"), F.lit(i)).bitwiseAND(255).cast("int").alias("set"))
        for i in range(0, 1 << _WORD_BITS, 8)
    ])
    start = F.shiftleft("block", _BLOCK_BITS) + F.col("word")
    parts = some.select(start.alias("start"), "vertex", "distance", "type", F.inline(octets)).where("`set` <> 0")
    pairs = parts.select(
        (F.col("start") + F.col("octet")).alias("start"), F.explode(F.get(F.expr(_PLACES), F.col("set"))).alias("place"), "vertex", "distance", "type"
    )
    blocks = pairs.select((F.col("start") + F.col("place")).alias("anchor"), "vertex", "distance", "type").where("anchor <> vertex")
    if keep_lone:
        lone = lone_vertices(edges, mode).select(F.col("vertex").alias("anchor"))
        blocks = blocks.unionByName(lone, allowMissingColumns=True)
    return blocks


def _new_bits(found: DataFrame, bits: list[str]) -> DataFrame:
    """What was not seen before."""
    new = [F.col(w).bitwiseAND(F.bitwise_not(f"seen_{w}")).alias(w) for w in bits]
    return found.select("vertex", "block", *new).where(reduce(lambda x, y: x | y, [c != 0 for c in new]))


def _marked_links(nbrs: DataFrame, mode: int) -> DataFrame:
    """The relation, with ``open`` telling whether the neighbour has neighbours itself."""
    if mode == BOTH:
        return nbrs.withColumn("open", F.lit(True))
    sources = nbrs.groupBy(F.col("vertex").alias("neighbor")).agg(F.count(F.lit(1)).alias("_degree"))
    return spread_lookup(nbrs, sources, "neighbor", "vertex").select(
        "vertex", "neighbor", F.col("_degree").isNotNull().alias("open")
    )


def pack_blocks(blocks: DataFrame, segment_size: int = SEGMENT_SIZE) -> DataFrame:
    """Blocks as lines ``anchor v d t v d t …``, in order of vertex.

    Rows are ``(anchor, segment, line)``. A block of up to ``segment_size``
    vertices is one line, segment 0; a longer one continues in further lines,
    each starting with the anchor. Runs a job when called, to find long blocks.
    """
    text = F.concat_ws(" ", F.lit(""), "vertex", "distance", "type").alias("text")
    entry = F.when(F.col("vertex").isNotNull(), F.struct("vertex", text))
    lists = segmented_lists(
        blocks, ["anchor"], ["anchor"], "vertex", [F.sort_array(F.collect_list(entry)).alias("_entries")], size=segment_size
    )
    return lists.select(
        "anchor",
        "segment",
        F.concat(F.col("anchor").cast("string"), F.array_join("_entries.text", "")).alias("line"),
    )

"""Keeping hot keys out of single tasks.

Two situations need more than Spark's own skew join, which looks at the bytes
going into a join and only at joins fed directly by a shuffle:

* a hub vertex met from both sides gives a product far larger than its input,
  so its pairs are cut into tiles that spread over the cluster
  (:func:`tiled_join`), and popular keys of a lookup are spread
  (:func:`spread_lookup`);
* a packed list of a hub's neighbours cannot be built in one task, so lists
  above a size come out as numbered segments (:func:`segment_rows`).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, GroupedData, Observation, Window, functions as F

from vertexweave.plans.storage import is_stored, stored

# Rows of one key met per side in one tile: a tile yields at most the square of it.
TILE_SIDE = 4096
# Pairs made by one task, about, and the tasks that a join is given for its pairs, at most.
PAIRS_PER_TASK = TILE_SIDE**2
MOST_TASKS = 20_000
# Tiles that a task is given, about, unless tiles of ``tile_side`` are larger.
TILES_PER_TASK = 8
# Groups of keys in which running numbers are summed up on their own.
KEY_GROUPS = 1024
# Entries in one packed list.
SEGMENT_SIZE = 100_000
# Entries of a group that are ranked as a whole, by one task; those of longer ones within blocks.
RANKED_WHOLE = 1 << 18
# Ids sharing all but their low 16 bits form a block; at most 65,536 blocks of 65,536 ids.
BLOCK_BITS = 16
# Below every block of 32-bit ids.
_NO_ITEM = -(1 << 15) - 1


def known(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Say that keys are not null in every branch alike.

    Spark infers this in some of the joins that share an input and not in
    others; said at the start, the branches read one shuffle of that input.
    """
    return rows.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]))


def tiled_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_item: str,
    right_item: str,
    tile_side: int = TILE_SIDE,
    pairs_per_task: int = PAIRS_PER_TASK,
    most_tasks: int = MOST_TASKS,
    buckets: int | None = None,
) -> DataFrame:
    """Inner join on ``key`` in which the pairs of a hot key are made by many tasks.

    A key whose pairs exceed ``tile_side`` squared gets its left rows cut into
    ``_l`` parts by ``left_item`` and its right rows into ``_r`` parts by
    ``right_item``, into tiles of that many pairs or, where that is more, of an
    eighth of a task's share. Each row is sent to every part of the other side, so each
    pair is made exactly once, and the copies are small next to the pairs. Tiles
    are numbered through and dealt to tasks in turn. The pairs, not the tiles,
    set the number of tasks, up to ``most_tasks``. All other keys are joined as
    they are; a ``right`` table kept in so many ``buckets`` by key stays in place.

    Both sides are read twice if there are hot keys, so they should be stored.
    Runs a job when called: it counts the rows of every key and writes the list
    of hot ones as a table. Spark broadcasts that table if its size allows, and
    sorts and merges otherwise, so the list may be of any length.
    """
    left, right = known(left, [key]), known(right, [key])
    n, m = F.col("_n"), F.col("_m")
    pairs, is_hot = n * m, n * m > F.lit(float(tile_side) ** 2)
    made = Observation()
    hot = stored(
        _counts(left, [key], "_n")
        .join(_counts(right, [key], "_m"), key)
        .observe(
            made,
            F.sum(F.when(is_hot, pairs)).alias("hot"),
            F.sum(F.when(~is_hot, pairs)).alias("cold"),
        )
        .where(is_hot)
    )
    hot_pairs, cold_pairs = made.get["hot"] or 0, made.get["cold"] or 0

    # The work lies in the pairs, not in the rows read, so their number sets
    # that of tasks. Small inputs are not packed into fewer tasks than usual.
    usual = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def tasks(made: float) -> int:
        return min(max(usual, ceil(made / pairs_per_task)), max(usual, most_tasks))

    # A tile that is small next to the share of a task only means more copies of its rows.
    in_tile = max(float(tile_side) ** 2, hot_pairs / tasks(hot_pairs) / TILES_PER_TASK)
    side, most = F.lit(in_tile**0.5), F.lit(in_tile)
    hot = hot.select(
        key,
        F.ceil(n / F.greatest(side, most / m)).cast("int").alias("_l"),
        F.ceil(m / F.greatest(side, most / n)).cast("int").alias("_r"),
    )

    if not hot_pairs:
        return left.repartition(buckets or tasks(cold_pairs), key).join(right, key)
    cold = left.join(hot, key, "left_anti").repartition(buckets or tasks(cold_pairs), key).join(right, key)
    tiles = stored(_numbered_tiles(hot, key))
    own, other = F.col("_l"), F.col("_r")
    row = F.col("_first") + _part(left_item, "_l") * other
    across = F.sequence(row, row + other - 1)
    column = F.col("_first") + _part(right_item, "_r")
    down = F.sequence(column, column + (own - 1) * other, other)
    left_tiles = left.join(tiles, key).select(*left.columns, F.explode(across).alias("_tile"))
    right_tiles = right.join(tiles, key).select(*[c for c in right.columns if c != key], F.explode(down).alias("_tile"))
    spread = (
        left_tiles.repartitionById(tasks(hot_pairs), "_tile")
        .join(right_tiles.repartitionById(tasks(hot_pairs), "_tile"), "_tile")
        .drop("_tile")
    )
    return cold.unionByName(spread)


def _numbered_tiles(hot: DataFrame, key: str) -> DataFrame:
    """Hot keys with ``_first``, the number of the first of their tiles.

    Numbers are summed up within groups of keys and over the groups; only the
    totals, one row for each of a fixed number of groups, meet in one task.
    """
    grouped = hot.withColumn("_group", F.pmod(F.hash(key), F.lit(KEY_GROUPS))).withColumn("_tiles", F.col("_l") * F.col("_r"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, 0)
    starts = (
        grouped.groupBy("_group")
        .agg(F.sum("_tiles").alias("_sum"))
        .select("_group", (F.sum("_sum").over(before) - F.col("_sum")).alias("_start"))
    )
    within = Window.partitionBy("_group").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("_start") + F.sum("_tiles").over(within) - F.col("_tiles")
    return grouped.join(starts, "_group").select(key, "_l", "_r", first.cast("int").alias("_first"))


def spread_lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str | Sequence[str],
    spread_by: str,
    rows_per_task: int = TILE_SIDE**2,
    counts: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Left join of ``rows`` with a ``table`` that is unique in ``key``.

    The rows of a key with more than ``rows_per_task`` of them are spread by
    another column, and the key's entry is sent to each part. Spark's skew join
    would not do this where the table comes out of an aggregate. ``counts``,
    ``(key, _n)``, saves counting the rows where that is known, or weighs them
    by what they find. ``tasks`` sets the number of tasks of the join, whose
    entries may be far larger than the rows. Runs a job when called, to write
    the list of such keys; it is broadcast only if small.
    """
    key = [key] if isinstance(key, str) else list(key)
    table = known(table, key)
    counts = _counts(rows, key, "_n") if counts is None else counts
    n = F.col("_n")
    hot = stored(
        counts.where(n > rows_per_task).select(*key, F.ceil(n / F.lit(float(rows_per_task))).cast("int").alias("_l"))
    )
    spread = rows.join(hot, key, "left").select(*rows.columns, _part(spread_by, "_l").alias("_tile"))
    copied = table.join(hot, key, "left").select(*table.columns, _every_part("_l").alias("_tile"))
    if tasks is not None:
        spread, copied = (side.repartition(tasks, *key, "_tile") for side in (spread, copied))
    return spread.join(copied, [*key, "_tile"], "left").drop("_tile")


def _counts(rows: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias(name))


def _part(item: str, parts: str) -> Column:
    return F.pmod(F.hash(item), F.coalesce(F.col(parts), F.lit(1)))


def _every_part(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))


def segment_rows(
    rows: DataFrame,
    group: Sequence[str],
    item: str,
    order: Column | None = None,
    block: Column | None = None,
    size: int = SEGMENT_SIZE,
    copies: str | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Add ``segment``: the number of the list, within its group, that a row goes to.

    Rows must be distinct in ``group`` and ``item``; a null ``item`` only keeps
    its group present. Groups of up to ``size`` entries are segment 0 whole. In
    longer ones, segment ``s`` holds the entries ranked ``s * size`` and up in
    ``order``. The rank is exact and no task sees more than ``RANKED_WHOLE``
    entries of a group: those of a longer one are ranked within blocks of ids,
    of which both the number per group and the length are bounded, and blocks
    are placed by their sizes. A ``block`` of
    one's own must sort as ``order`` does and not be null.

    ``copies`` names a column that counts repeats of a row. A row whose repeats
    run across segments comes out once for each, with its share of them.

    The groups to split are found first, in a job of their own, so that rows
    are not shuffled to learn that there are none. ``counts``, the group
    columns and ``_n``, may give upper bounds that are cheaper to come by than
    counts of ``rows``; without them, rows that are not a stored table become
    one, as they are read twice.
    """
    segments, split, _ = _segmented(rows, list(group), item, order, block, size, copies, counts)
    return segments if split else segments.withColumn("segment", F.lit(0))


def _segmented(
    rows: DataFrame,
    group: list[str],
    item: str,
    order: Column | None,
    block: Column | None,
    size: int,
    copies: str | None,
    counts: DataFrame | None,
) -> tuple[DataFrame, bool, bool]:
    """Rows with ``segment``, and True; or, if no group is too long, the rows as they are, and False. Whether groups lie together."""
    if counts is None and not is_stored(rows):
        rows = stored(rows)
    rows = known(rows, group)
    weight = F.when(F.col(item).isNotNull(), F.col(copies) if copies else F.lit(1)).otherwise(0)
    if counts is None:
        counts = rows.groupBy(*group).agg(F.sum(weight).alias("_n"))
    made = Observation()
    huge = F.col("_n") > max(size, RANKED_WHOLE)
    long_groups = counts.where(F.col("_n") > size)
    long_groups = stored(long_groups.observe(made, F.count(F.lit(1)).alias("long"), F.count(F.when(huge, 1)).alias("huge")))
    if not made.get["long"]:
        return rows, False, False

    order = F.col(item) if order is None else order
    if block is None:
        block = F.coalesce(F.shiftright(F.col(item), BLOCK_BITS), F.lit(_NO_ITEM))
    if not made.get["huge"]:
        in_group = Window.partitionBy(*group).orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
        entries = rows.select(*rows.columns, order.alias("_order"), weight.cast("bigint").alias("_w"))
        placed = entries.withColumn("_from", F.sum("_w").over(in_group) - F.col("_w"))
        return _in_segments(placed, rows.columns, size, copies), True, True
    marked = spread_lookup(rows, long_groups.withColumnRenamed("_n", "_long"), group, item, counts=long_groups)
    short = marked.where(F.col("_long").isNull()).select(*rows.columns, F.lit(0).alias("segment"))

    entries = marked.where(F.col("_long").isNotNull()).select(
        *rows.columns, block.alias("_block"), order.alias("_order"), weight.cast("bigint").alias("_w")
    )
    by_block = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    starts = (
        entries.groupBy(*group, "_block")
        .agg(F.sum("_w").alias("_in_block"))
        .select(*group, "_block", (F.sum("_in_block").over(by_block) - F.col("_in_block")).alias("_start"))
    )
    in_block = Window.partitionBy(*group, "_block").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    placed = entries.join(starts, [*group, "_block"]).withColumn(
        "_from", F.col("_start") + F.sum("_w").over(in_block) - F.col("_w")
    )
    return short.unionByName(_in_segments(placed, rows.columns, size, copies)), True, False


def _in_segments(placed: DataFrame, columns: list[str], size: int, copies: str | None) -> DataFrame:
    """Rows whose entries before them in their group are ``_from``, by segment."""
    if copies is None:
        return placed.select(*columns, F.floor(F.col("_from") / size).cast("int").alias("segment"))
    until = F.col("_from") + F.col("_w")
    first = F.floor(F.col("_from") / size).cast("int")
    last = F.greatest(first, F.floor((until - 1) / size).cast("int"))
    reached = placed.withColumn("segment", F.explode(F.sequence(first, last)))
    begin = F.col("segment").cast("bigint") * size
    share = F.least(until, begin + size) - F.greatest(F.col("_from"), begin)
    return reached.select(*[share.alias(c) if c == copies else F.col(c) for c in columns], "segment")


def segmented_lists(
    rows: DataFrame,
    by: Sequence[str],
    group: Sequence[str],
    item: str,
    lists: Sequence[Column],
    order: Column | None = None,
    block: Column | None = None,
    size: int = SEGMENT_SIZE,
    copies: str | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``by``, ``segment`` and aggregates that are lists of the rows in a segment.

    Segments are those of :func:`segment_rows` over ``group``. The rows are
    shuffled once: by the segment too only where there is one to speak of, as
    Spark would take a constant for a key of its own and shuffle again.
    """
    segments, split, together = _segmented(rows, list(group), item, order, block, size, copies, counts)
    names = [*by, "segment"] if split else list(by)
    if together and set(group) <= set(names):
        return segments.groupBy(*names).agg(*lists)
    found = list_groups(segments, *names).agg(*lists)
    if split:
        return found
    return found.select(*by, F.lit(0).alias("segment"), *[c for c in found.columns if c not in by])


def list_groups(rows: DataFrame, *keys: str) -> GroupedData:
    """Group rows whose aggregate is a list.

    Lists do not shrink when built before the shuffle, so the rows are shuffled as they are.
    """
    return rows.repartition(*keys).groupBy(*keys)

"""Writers for the stored layouts and the text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vertexweave.functions.text import TOKEN_SEPARATORS


def write_table(
    df: DataFrame,
    path: str,
    part: str | None = None,
    sort: tuple[str, ...] = ("vertex",),
    bloom: tuple[str, ...] = (),
    row_group_bytes: int | None = None,
) -> None:
    """Parquet, in folders by ``part`` if one is named and sorted within files.

    Rows are ranged on part and sort columns together. So a task writes to few
    folders, a large part is written by several tasks, and readers can skip
    row groups by id. Columns in ``bloom`` get a Bloom filter per row group,
    as large as their values ask for: reads by keys that are scattered over the
    files skip row groups by it, where least and greatest values tell nothing.
    Row groups have about ``row_group_bytes``, if that is given.
    """
    keys = sort if part is None else (part, *sort)
    writer = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    if bloom:
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    if row_group_bytes is not None:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    (writer if part is None else writer.partitionBy(part)).parquet(path)


def write_regions(df: DataFrame, path: str, n_regions: int, region: str = "region", sort: tuple[str, ...] = ("vertex",)) -> None:
    """Parquet in folders by region, each written by one task as one sorted file.

    The region is the number of the task, so rows take one shuffle without
    sampling. A region should be sized for a task; readers of some regions read only their folders.
    """
    dealt = df.repartitionById(n_regions, F.col(region)).sortWithinPartitions(region, *sort)
    dealt.write.partitionBy(region).parquet(path)


def write_lines(df: DataFrame, path: str, line: str = "line", order: tuple[str, ...] = ()) -> None:
    """One text column as lines; with ``order``, sorted over the files in the order of their names."""
    (df.orderBy(*order) if order else df).select(line).write.text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Tab-separated edge list, from the first two columns."""
    edges.select(edges.columns[:2]).write.csv(path, sep=TOKEN_SEPARATORS[1])


def hop_lines(hop: DataFrame) -> DataFrame:
    """Hop rows as text, ``! anchor vertex distance type``, or ``@ anchor`` for a lone anchor."""
    return hop.select(
        F.when(F.col("vertex").isNull(), _joined(F.lit("@"), F.col("anchor")))
        .otherwise(_joined(F.lit("!"), F.col("anchor"), F.col("vertex"), F.col("distance"), F.col("type")))
        .alias("value")
    )


def _joined(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def stats_lines(stats: DataFrame) -> DataFrame:
    """The figures of ``block_stats`` as report lines, in order of ``position``."""
    # The wording of the report.
    lines = F.array(
        F.concat(F.lit("# anchor vertices: "), F.col("anchors")),
        F.concat(F.lit("# total edges (in EVBs): "), F.col("total_entries")),
        F.concat(F.lit("# avg. edges per EVB: "), F.col("mean_entries")),
        F.concat(F.lit("# min edges: "), F.col("min_entries"), F.lit(" of anchor vertex "), F.col("min_anchor")),
        F.concat(F.lit("# max edges: "), F.col("max_entries"), F.lit(" of anchor vertex "), F.col("max_anchor")),
    )
    return stats.select(F.posexplode(lines).alias("position", "line"))

"""Ranges of keys: which region of a range-partitioned table a row belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vertexweave.functions.ids import padded, region_key_width


def assign_region_uniform(df: DataFrame, n_regions: int, max_id: int, vertex: str = "vertex") -> DataFrame:
    """Add ``region``, by equal ranges of ids up to ``max_id``.

    The bounds are multiples of ``max_id // n_regions``; the last region takes
    what is above them. Ids sort as unsigned, so negative ones are in it too.
    """
    _check_regions(n_regions)
    step = max_id // n_regions
    if step < 1 and n_regions > 1:
        raise ValueError("max_id must be at least the number of regions, or bounds coincide")
    if n_regions == 1:
        return df.withColumn("region", F.lit(0))
    last = F.lit(n_regions - 1)
    by_range = F.least(F.floor(F.col(vertex) / F.lit(step)).cast("int"), last)
    return df.withColumn("region", F.when(F.col(vertex) < 0, last).otherwise(by_range))


def assign_region_hash(df: DataFrame, n_regions: int, n_parts: int, part: str = "part") -> DataFrame:
    """Add ``region``, by equal ranges of partitions as their padded keys sort.

    Each region has ``n_parts // n_regions`` partitions, one at least, and the
    last takes the rest; with more regions than partitions some stay empty.
    Keys and bounds are compared as texts, whatever the number of the partition.
    """
    _check_regions(n_regions)
    step = max(n_parts // n_regions, 1)
    width = region_key_width(n_parts)
    key = F.concat(padded(F.col(part), n_parts), F.lit("-"))
    if n_regions == 1:
        return df.withColumn("region", F.lit(0))
    bounds = F.transform(
        F.sequence(F.lit(1), F.lit(n_regions - 1)),
        lambda i: F.concat(F.format_string(f"%0{width}d", i * F.lit(step)), F.lit("-")),
    )
    return df.withColumn("region", F.size(F.filter(bounds, lambda bound: bound <= key)))


def _check_regions(n_regions: int) -> None:
    if n_regions < 1:
        raise ValueError("the number of regions is 1 or more")

"""Column helpers for partition numbers and stored keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def region_key_width(n_parts: int) -> int:
    """Digits used for a partition number in a key: as many as ``n_parts - 1`` takes."""
    return len(str(n_parts - 1))


def padded(part: Column, n_parts: int) -> Column:
    return F.format_string(f"%0{region_key_width(n_parts)}d", part)


def part_of(vertex: Column, n_parts: int) -> Column:
    """Remainder with the sign of the vertex, so a negative id gets a negative part."""
    return (vertex % F.lit(n_parts)).cast("int")


def unsigned_order(vertex: Column) -> Column:
    """Sort position of an id stored as four big-endian bytes: negatives come last."""
    wide = vertex.cast("bigint")
    return F.when(wide < 0, wide + F.lit(1 << 32)).otherwise(wide)

"""Do two engines agree? Comparison of per-vertex results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vertexweave.plans.skew import spread_lookup

# Fixed value: how an unreachable vertex is written.
INFINITY = "2147483647"


def compare_values(first: DataFrame, second: DataFrame, infinity: bool = False) -> DataFrame:
    """One row of counts and a verdict over ``(vertex, value)`` results.

    The first side has one value for each vertex: the last by its ``line``
    column, if it has one; otherwise a vertex with two values fails the query.
    The second side counts all its rows. They match when the counts agree and
    no vertex known to the first side has another value; with ``infinity``,
    infinite rows are taken off the second count. A vertex only one side has is
    reported but is not a mismatch.
    """
    # Repeats of the first side meet below, in the same group.
    known_values = _last_values(first) if "line" in first.columns else first
    rows = known_values.select("vertex", "value", F.lit(1).alias("_first"), F.lit(0).alias("_second"))
    rows = rows.unionByName(
        second.select("vertex", "value", F.lit(0).alias("_first"), F.lit(1).alias("_second"))
    )
    # Equal values of a vertex meet in one group. No join is needed, and a
    # vertex repeated many times is down to a few rows before it is shuffled.
    pairs = rows.groupBy("vertex", "value").agg(
        F.max("_first").alias("_first"), F.sum("_second").alias("_second")
    )
    by_vertex = pairs.groupBy("vertex").agg(
        F.sum("_first").alias("_first"),
        F.sum("_second").alias("_second"),
        F.sum(F.when(F.col("_first") == 1, F.col("_second")).otherwise(0)).alias("_equal"),
        F.sum(F.when(F.col("value") == INFINITY, F.col("_second")).otherwise(0)).alias("_infinite"),
    )
    known = (
        F.when(F.col("_first") <= 1, F.col("_first"))
        .otherwise(
            F.raise_error(F.concat(F.lit("more than one value, and no order, for vertex "), F.col("vertex"))).cast("bigint")
        )
    )
    counts = by_vertex.withColumn("_first", known).agg(
        _total(F.col("_first")).alias("first_vertices"),
        _total(F.col("_second")).alias("second_vertices"),
        _total(F.col("_infinite")).alias("second_infinite"),
        _total(F.when(F.col("_first") == 1, F.col("_second") - F.col("_equal"))).alias("mismatches"),
        _total(F.when(F.col("_first") == 0, F.col("_second"))).alias("missing_in_first"),
        _total(F.when(F.col("_second") == 0, F.col("_first"))).alias("missing_in_second"),
    )
    discount = F.col("second_infinite") if infinity else F.lit(0)
    same_size = F.col("first_vertices") == F.col("second_vertices") - discount
    return counts.withColumn("matches", same_size & (F.col("mismatches") == 0))


def value_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(vertex, first_value, second_value, second_rows)`` for values of the second side that differ.

    ``first_value`` is null where the first side lacks the vertex. Equal rows
    of the second side come as one, with their number.
    """
    known_values = _last_values(first).select("vertex", F.col("value").alias("first_value"))
    asked = second.groupBy("vertex", F.col("value").alias("second_value")).agg(
        F.count(F.lit(1)).alias("second_rows")
    )
    return (
        spread_lookup(asked, known_values, "vertex", "second_value")
        .where(~F.col("second_value").eqNullSafe(F.col("first_value")))
        .select("vertex", "first_value", "second_value", "second_rows")
    )


def _last_values(first: DataFrame) -> DataFrame:
    if "line" not in first.columns:
        return first.select("vertex", "value").distinct()
    return first.groupBy("vertex").agg(F.max_by("value", "line").alias("value"))


def _total(column):
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")

"""The partition dictionary: ``vertex,partition`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vertexweave.functions.text import strict_int


def read_partition_dict(lines: DataFrame) -> DataFrame:
    """``(vertex INT, part INT)``, one row for each vertex.

    With a ``line`` column the last line of a vertex wins. Without one there is
    no order to go by, and a vertex with two different parts fails the query.
    """
    fields = F.split("value", ",")
    entries = lines.select(strict_int(fields[0]).alias("vertex"), strict_int(fields[1]).alias("part"), "*")
    grouped = entries.groupBy("vertex")
    if "line" in lines.columns:
        return grouped.agg(F.max_by("part", "line").alias("part"))
    return grouped.agg(F.min("part").alias("part"), F.max("part").alias("_other")).select(
        "vertex",
        F.when(F.col("part") == F.col("_other"), F.col("part"))
        .otherwise(F.raise_error(F.format_string("vertex %d has more than one part", "vertex")).cast("int"))
        .alias("part"),
    )

"""Per-vertex results: ``vertex value`` lines, both kept as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vertexweave.functions.text import tokens


def read_vertex_values(lines: DataFrame) -> DataFrame:
    """``(vertex STRING, value STRING)``, and ``line`` where the input has it."""
    pair = tokens(F.col("value"))
    order = ["line"] if "line" in lines.columns else []
    return lines.where(F.size(pair) == 2).select(pair[0].alias("vertex"), pair[1].alias("value"), *order)


def rejected_value_lines(lines: DataFrame) -> DataFrame:
    """The lines :func:`read_vertex_values` leaves out."""
    return lines.where(F.size(tokens(F.col("value"))) != 2)

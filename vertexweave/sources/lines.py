"""Text lines, with a position for the formats in which line order matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file or folder as ``(value, line)``.

    ``line`` sorts as the lines do: by file name, by the split of the file a
    task reads, and by the running number within the task. It needs no pass of
    its own, and is dropped from the scan when nothing selects it.
    """
    return spark.read.text(path).select("value", line_position().alias("line"))


def line_position() -> Column:
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"),
    )

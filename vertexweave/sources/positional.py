"""Positional adjacency: a vertex count, then line ``i`` lists the neighbours of vertex ``i``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from vertexweave.functions.text import strict_int, tokens
from vertexweave.plans.storage import stored
from vertexweave.sources.lines import read_lines


def positional_to_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(vertex INT, neighbor INT)``; repeats and edges to oneself are kept.

    ``path`` is one file, or a folder whose files hold one graph in the order
    of the first number in their names, then of their names; part 99999 comes
    before part 100000. Names that differ before that number, or of which only
    some have one, fail the query. Runs a job when called, to count lines.
    """
    # The header has to be a number, though nothing is made of it here.
    listed = _numbered(spark, path).where((F.col("line_no") > 0) | strict_int(F.col("value")).isNull())
    return listed.select(
        (F.col("line_no") - 1).cast("int").alias("vertex"), F.explode(tokens(F.col("value"))).alias("token")
    ).where(F.col("token") != "").select("vertex", strict_int(F.col("token")).alias("neighbor"))


def positional_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: the declared vertex count, the count of lines found, and whether they agree."""
    numbered = _numbered(spark, path)
    # The header is picked before it is read as a number; all other lines are not.
    header = F.max(F.when(F.col("line_no") == 0, F.col("value")))
    return (
        numbered.agg(header.alias("header"), F.count(F.lit(1)).alias("lines"))
        .where(F.col("lines") > 0)
        .select(
            strict_int(F.col("header")).alias("declared"),
            (F.col("lines") - 1).alias("actual"),
        )
        .withColumn("agrees", F.col("declared") == F.col("actual"))
    )


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number in the whole input, counted from 0.

    The lines of each split are counted and summed up within each file, the
    files' totals are summed up in file order, and each line adds its place in
    the split. Only totals of ranges of files meet in one task. The where they are read: they look their split up by a short number in a table
    that is broadcast if its size allows.
    """
    lines = read_lines(spark, path).select("value", "line.*")
    counted = stored(
        lines.groupBy("file", "start").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    )
    within = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    splits = counted.withColumn("in_file", F.sum("n").over(within) - F.col("n"))
    files = _in_order(counted.groupBy("file").agg(F.sum("n").alias("lines")))
    starts = stored(
        splits.join(files, "file").select(
            _split_id().alias("split"), "first", "n", (F.col("before") + F.col("in_file")).alias("before")
        )
    )
    place = F.col("seq") - F.col("first")
    # The two passes must cut the files alike. Should they not, for instance as
    # executors join in between, the query fails and can be run again.
    sound = F.col("first").isNotNull() & (place >= 0) & (place < F.col("n"))
    return lines.withColumn("split", _split_id()).join(starts, "split", "left").select(
        "value",
        F.when(sound, F.col("before") + place)
        .otherwise(F.raise_error(F.lit("input was split differently by two passes")).cast("bigint"))
        .alias("line_no"),
    )


def _split_id() -> Column:
    return F.xxhash64("file", "start")


def _in_order(files: DataFrame) -> DataFrame:
    """Add ``before``, the lines in all earlier files.

    Lines are summed up within ranges of files and over the ranges, of which
    there are as many as shuffle partitions at most.
    """
    name = F.element_at(F.split("file", "/"), -1)
    prefix, number = F.col("prefix"), F.col("number")
    forms = Observation()
    ranged = stored(
        files.select(
            "file", "lines",
            F.regexp_extract(name, "^([^0-9]*)[0-9]", 1).alias("prefix"),
            F.regexp_extract(name, "([0-9]+)", 1).try_cast("decimal(38, 0)").alias("number"),
        )
        .observe(
            forms,
            (F.min(prefix) == F.max(prefix)).alias("one_prefix"),
            F.min_by("file", prefix).alias("first"),
            F.max_by("file", prefix).alias("last"),
            F.count(number).alias("numbered"),
            F.count(F.lit(1)).alias("files"),
        )
        .repartitionByRange("number", "file")
        .withColumn("range", F.spark_partition_id())
    )
    seen = forms.get
    if seen["files"] and not (seen["one_prefix"] and seen["numbered"] in (0, seen["files"])):
        raise ValueError(
            f"file names of different forms, so of unknown order: {seen['first']}, {seen['last']}"
        )
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    starts = (
        ranged.groupBy("range")
        .agg(F.sum("lines").alias("in_range"))
        .select("range", (F.sum("in_range").over(earlier) - F.col("in_range")).alias("start"))
    )
    within = Window.partitionBy("range").orderBy("number", "file").rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(starts, "range").select(
        "file", (F.col("start") + F.sum("lines").over(within) - F.col("lines")).alias("before")
    )

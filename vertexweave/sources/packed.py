"""Blocks in their text forms, back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from vertexweave.functions.text import SEPARATOR_PATTERN, strict_int, tokens, trim_control


def read_blocks(lines: DataFrame) -> DataFrame:
    """Rows ``(anchor, vertex, distance, type)`` of packed lines ``anchor v d t v d t …``.

    A line with the anchor alone gives one row with nulls. The segments of a
    long block are lines of the same anchor and need no joining up.
    """
    words = tokens(F.col("value"))
    triples = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 3).cast("int") - 1),
        lambda i: F.struct(
            F.get(words, i * 3 + 1).alias("vertex"),
            F.get(words, i * 3 + 2).alias("distance"),
            F.get(words, i * 3 + 3).alias("type"),
        ),
    )
    # A block must hold whole triples; a cut-off line fails rather than losing entries.
    whole = F.when(F.size(words) % 3 == 1, words).otherwise(
        F.raise_error(F.concat(F.lit("broken block: "), F.col("value"))).cast("array<string>")
    )
    return (
        lines.select(
            whole[0].alias("anchor"),
            F.explode_outer(F.when(F.size(words) > 1, triples)).alias("entry"),
        )
        .select(
            strict_int(F.col("anchor")).alias("anchor"),
            F.when(F.col("entry").isNotNull(), strict_int(F.col("entry.vertex"))).alias("vertex"),
            F.when(F.col("entry").isNotNull(), strict_int(F.col("entry.distance"))).alias("distance"),
            F.col("entry.type").alias("type"),
        )
    )


# Why a hop line is left out.
MARK, COUNT = "neither ! nor @", "wrong number of tokens"


def read_hop_rows(lines: DataFrame) -> DataFrame:
    """Rows of hop lines ``! anchor vertex distance type`` and ``@ anchor``.

    Lines with another number of tokens are left out; a lone anchor has nulls.
    """
    return read_hop_rows_reported(lines)[0]


def read_hop_rows_reported(lines: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows of :func:`read_hop_rows`, and counts of the lines left out, by reason, made in the same pass."""
    words = F.split(trim_control(F.col("value")), SEPARATOR_PATTERN)
    hop = (words[0] == "!") & (F.size(words) == 5)
    lone = (words[0] == "@") & (F.size(words) == 2)
    marked = words[0].isin("!", "@")
    counted = Observation()
    observed = lines.observe(
        counted, F.count(F.when(~marked, 1)).alias(MARK), F.count(F.when(marked & ~hop & ~lone, 1)).alias(COUNT)
    )
    return _hop_rows(observed.where(hop | lone), words, hop), counted


def _hop_rows(lines: DataFrame, words: Column, hop: Column) -> DataFrame:
    return lines.select(
        strict_int(words[1]).alias("anchor"),
        F.when(hop, strict_int(F.get(words, F.lit(2)))).alias("vertex"),
        F.when(hop, strict_int(F.get(words, F.lit(3)))).alias("distance"),
        F.when(hop, F.get(words, F.lit(4))).alias("type"),
    )


def rejects(spark: SparkSession, counted: Observation) -> DataFrame:
    """``(reason, lines)`` of what a reader left out. Waits for a job that reads all that it kept."""
    return spark.createDataFrame(sorted(counted.get.items()), "reason string, lines bigint")

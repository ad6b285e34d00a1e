"""Edge lists: text lines or table columns to ``(src INT, dst INT)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from vertexweave.functions.text import (
    INTEGER_PATTERN, SEPARATOR_PATTERN, TOKEN_SEPARATORS, is_integer, strict_int, tokens, trim_control,
)

_EDGE_LINE = f"\\A[\\x00-\\x20]*{INTEGER_PATTERN}{SEPARATOR_PATTERN}{INTEGER_PATTERN}[\\x00-\\x20]*\\z"


def read_edges(lines: DataFrame) -> DataFrame:
    """Edges of a graph from lines in column ``value``; repeated edges are kept.

    A line counts when it holds two 32-bit integers and nothing else. Comments
    (``#``), other lines and edges from a vertex to itself are left out.
    """
    # The pattern already leaves out comments and lines without exactly two
    # numbers; the cast then only has to reject numbers that are too long. The
    # numbers are before the first and after the last separator.
    spaced = F.translate(trim_control(F.col("value")), TOKEN_SEPARATORS, " " * len(TOKEN_SEPARATORS))
    return (
        lines.where(F.col("value").rlike(_EDGE_LINE))
        .select(
            F.substring_index(spaced, " ", 1).try_cast("int").alias("src"),
            F.substring_index(spaced, " ", -1).try_cast("int").alias("dst"),
        )
        .where(F.col("src") != F.col("dst"))
    )


# Why a line is left out.
COMMENT, TOKENS, NUMBER, LOOP = "comment", "not two tokens", "not a 32-bit integer", "edge to itself"


def read_edges_reported(lines: DataFrame) -> tuple[DataFrame, Observation]:
    """The edges of :func:`read_edges`, and counts of the lines left out, by reason.

    The counts are made by whatever job first reads all of the edges, in the
    same pass; :func:`rejects` gives them as a table afterwards.
    """
    text = trim_control(F.col("value"))
    pair = tokens(text)
    ends = [F.when(is_integer(F.get(pair, F.lit(i))), F.get(pair, F.lit(i)).try_cast("int")) for i in (0, 1)]
    reason = (
        F.when(text.startswith("#"), COMMENT)
        .when(F.size(pair) != 2, TOKENS)
        .when(F.col("src").isNull() | F.col("dst").isNull(), NUMBER)
        .when(F.col("src") == F.col("dst"), LOOP)
    )
    counted = Observation()
    parsed = lines.select("value", ends[0].alias("src"), ends[1].alias("dst")).withColumn("reason", reason)
    observed = parsed.observe(
        counted, *[F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in (COMMENT, TOKENS, NUMBER, LOOP)]
    )
    return observed.where(F.col("reason").isNull()).select("src", "dst"), counted


def read_edges_raw(lines: DataFrame) -> DataFrame:
    """Edges as an exploratory scan sees them.

    ``#`` marks a comment only in the first column, edges from a vertex to
    itself stay, and a token that is not an integer fails the query. ``dst`` is
    read only where it is used, so a scan that asks for ``src`` alone does not
    fail on a bad second token.
    """
    pair = tokens(F.col("value"))
    return lines.where(~F.col("value").startswith("#") & (F.size(pair) == 2)).select(
        strict_int(pair[0]).alias("src"), strict_int(pair[1]).alias("dst")
    )


def edges_from_columns(table: DataFrame, src: Column, dst: Column, keep_self: bool = False) -> DataFrame:
    """Edges from two columns of a table; an id beyond 32 bits fails the query."""
    edges = table.select(src.cast("int").alias("src"), dst.cast("int").alias("dst"))
    if keep_self:
        return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return edges.where(F.col("src") != F.col("dst"))

"""Reads of stored rows by key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType

from vertexweave.functions.text import strict_int, tokens


# Keys of one point read; more are a table of their own.
MOST_KEYS = 1000
# As many keys go to the scan one by one; of a longer list, Spark hands down least and greatest only.
_KEYS_PER_LIST = 10


def read_members(rows: DataFrame, keys: Sequence[int | str], key: str = "vertex") -> DataFrame:
    """All rows of a stored table for a few named keys, at most ``MOST_KEYS``; an unknown one has none.

    The keys are part of the plan, so the scan itself skips row groups, by
    order, dictionary or Bloom filter (see ``write_table``), and no row is
    shuffled. Repeated keys count once, and a null key has no rows. Keys that
    are many, or come out of a table, are for :func:`lookup_members`.
    """
    named = [k for k in dict.fromkeys(keys) if k is not None]
    if len(named) > MOST_KEYS:
        raise ValueError(f"a point read takes at most {MOST_KEYS} keys")
    lists = [F.col(key).isin(named[i : i + _KEYS_PER_LIST]) for i in range(0, len(named), _KEYS_PER_LIST)]
    return rows.where(reduce(or_, lists, F.lit(False)))


def lookup_members(rows: DataFrame, keys: DataFrame, key: str = "vertex") -> DataFrame:
    """All rows of a long table whose ``key`` is among ``keys``; an unknown key has none.

    No side is forced to be broadcast: Spark does so by size, and prunes the
    folders of a table partitioned by ``key``.
    """
    return rows.join(keys.select(key), key, "left_semi")


def lookup_column(table: DataFrame, keys: DataFrame, column: str, key: str = "vertex") -> DataFrame:
    """``(key, neighbor)`` from one list column of a stored table, for keys of any type.

    The column may be an array or a packed text, whose tokens must be 32-bit
    integers. The other columns are not read. A column the table lacks gives
    no rows.
    """
    if column not in table.columns:
        return table.select(key, F.lit(None).cast("int").alias("neighbor")).where(F.lit(False))
    found = lookup_members(table.select(key, column), keys, key)
    if isinstance(table.schema[column].dataType, ArrayType):
        return found.select(key, F.explode(column).alias("neighbor"))
    parts = found.select(key, F.explode(tokens(F.col(column))).alias("_token")).where("_token <> ''")
    return parts.select(key, strict_int(F.col("_token")).alias("neighbor"))

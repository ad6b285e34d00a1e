"""Helpers for the frames that operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The characters between words, space and 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]+"
# Bytes of an Arrow batch on its way to a Python worker.
_BATCHES, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Set the size of Arrow batches for the session, if it has none of its own.

    A batch lies in several buffers on either side, for every task at once, so
    long texts in batches of the usual size fill an executor beside its heap.
    """
    if spark.conf.get(_BATCHES, None) is None:
        spark.conf.set(_BATCHES, str(_BATCH_BYTES))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``doc_id`` and ``text``: other columns, whatever their names, go no further."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` has not, near to those asked for."""
    taken = {c.lower() for c in docs.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

"""Exact duplicates by a heavy-hitter split.

A digest of the normalised text stands for it. Misra-Gries counters (Spark's
``freqItems``) name every digest that more than a ``support``-th part of the
rows have, and maybe others. Those are counted exactly, and as there are at
most ``1 / support`` of them, the ones that do repeat are broadcast: their
rows are decided, or removed, where they are read. Every other digest has few
rows and goes through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vertexweave.llm.frames import SPACES, fresh
from vertexweave.plans.storage import stored

# Misra-Gries keeps the inverse of this many counters; freqItems takes 1e-4 and up.
SUPPORT = 1 / 4096


def text_sha256(text: Column) -> Column:
    """SHA-256 of the text with each run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the smallest id stays. A null text counts as
    empty. Ids that are null come after all others. Of repeated rows with the
    same id and text one stays. An empty table gives an empty result; other
    columns are not read.
    """
    return _decided(docs, id_col, text_col, support).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _decided(docs: DataFrame, id_col: str, text_col: str, support: float) -> DataFrame:
    # The texts are read once, for this table of ids and digests.
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(text_sha256(F.col(text_col))).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    ).withColumn("short", F.xxhash64("digest"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")

    frequent = rows.freqItems(["short"], support).select(F.explode("short_freqItems").alias("short")).distinct()
    # At most 1 / support rows: verified winners among the frequent digests.
    heavy = stored(
        rows.join(F.broadcast(frequent), "short", "left_semi")
        .groupBy("digest")
        .agg(F.min(order).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > 1)
    )
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    columns = ["doc_id", "digest", "row", "keep", "group_size"]
    alike = Window.partitionBy("digest")
    rest = marked.where(F.col("keep").isNull()).select(
        "doc_id", "digest", "row",
        F.min(order).over(alike).alias("keep"), F.count(F.lit(1)).over(alike).alias("group_size"),
    )
    decided = marked.where(F.col("keep").isNotNull()).select(*columns).unionByName(rest)
    return decided.withColumn("kept", F.col("row") == F.col("keep.row"))


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only ids and digests are shuffled to decide, not the texts. Where a row
    that stays has repeats with the same id and text, these alone are then
    grouped and one of them is taken.
    """
    decided = stored(_decided(docs, id_col, text_col, support))
    first, copies = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")), F.count(F.lit(1))
    stays = (
        decided.where(first)
        .groupBy("doc_id", "digest")
        .agg(copies.alias("copies"))
        .select(F.col("doc_id").alias("kept_doc_id"), F.col("digest").alias("kept_digest"), "copies")
    )
    (digest,) = fresh(docs, "text_digest")
    rows = docs.withColumn(digest, F.unhex(text_sha256(F.col(text_col))))

    def chosen(stays: DataFrame) -> DataFrame:
        same = rows[id_col].eqNullSafe(stays["kept_doc_id"]) & (rows[digest] == stays["kept_digest"])
        return rows.join(stays, same, "left_semi")

    repeated = stored(stays.where("copies > 1"))
    if repeated.isEmpty():
        return chosen(stays).select(*docs.columns)
    once = chosen(stays.where("copies = 1")).select(*docs.columns)
    again = chosen(repeated).dropDuplicates([id_col, digest]).select(*docs.columns)
    return once.unionByName(again)

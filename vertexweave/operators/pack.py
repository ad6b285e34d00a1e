"""Long rows packed into one text for each stored row.

Members follow the order of the stored bytes: unsigned, so negative ids come
last, and by characters where members are texts. The members of a row are a
set: repeats count once. Rows that are not a stored table become one when an
operator is called, as they are read twice, and a job finds the long ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vertexweave.functions.ids import padded, unsigned_order
from vertexweave.functions.text import strict_int, tokens
from vertexweave.plans.skew import BLOCK_BITS, SEGMENT_SIZE, segmented_lists, spread_lookup
from vertexweave.plans.storage import stored

# Ids that agree in this many leading digits form a block when ids sort as texts.
_TEXT_BLOCK_DIGITS = 5


def merge_row(
    rows: DataFrame, keys: DataFrame, key: str = "vertex", member: str = "neighbor", segment_size: int = SEGMENT_SIZE
) -> DataFrame:
    """``(key, segment, members)`` for the rows whose ``key`` is among ``keys``; the new key is ``new<key>``.

    Keys may be of any type. Members are made distinct before the keys are
    looked up, and a hub's are spread for that, so none of its rows meet in one task.
    """
    asked = keys.select(key).distinct().withColumn("_asked", F.lit(True))
    members = rows.select(key, member).distinct()
    wanted = spread_lookup(members, asked, key, member).where("_asked").select(key, member)
    return _packed_ids(wanted, key, member, segment_size).select(
        F.concat(F.lit("new"), F.col(key).cast("string")).alias("key"), "segment", "members"
    )


def merge_partitions(members: DataFrame, n_parts: int, segment_size: int = SEGMENT_SIZE) -> DataFrame:
    """``(key, segment, members)`` for parts 0 to ``n_parts - 1``, keyed ``newhash<part>``."""
    return _packed_ids(_in_range(members, n_parts), "part", "vertex", segment_size).select(
        _hash_key(), "segment", "members"
    )


def merge_partitions_range(members: DataFrame, n_parts: int, segment_size: int = SEGMENT_SIZE) -> DataFrame:
    """As :func:`merge_partitions`, keyed ``<padded part>-hash``.

    These rows replace the member rows of their parts; :func:`unmerged_members` has what is left of those.
    """
    return _packed_ids(_in_range(members, n_parts), "part", "vertex", segment_size).select(
        F.concat(padded(F.col("part"), n_parts), F.lit("-hash")).alias("key"), "segment", "members"
    )


# Rows of a stored member table, before and after they are packed.
STORED_MEMBERS = "vertex int, key string, segment int, members string, part int"


def stored_members(spark: SparkSession, path: str) -> DataFrame:
    """``(vertex, key, segment, members, part)`` of a table of members in folders by part.

    A row has a vertex, or is one that :func:`replace_members` put in place of
    such rows and has the other columns instead.
    """
    return spark.read.schema(STORED_MEMBERS).parquet(path)


def replace_members(spark: SparkSession, path: str, n_parts: int, segment_size: int = SEGMENT_SIZE) -> DataFrame:
    """Put the rows of :func:`merge_partitions_range` in place of the member rows they are made of; returns the table.

    The packed rows are written to the shared folder first. Only folders of
    parts that have some are then replaced, all in the commit of one job: an
    attempt that fails leaves the old rows, and can be made again. Members that
    came to a part after it was packed are packed with those already there.
    """
    rows = _in_range(stored_members(spark, path), n_parts)
    listed = F.transform(tokens(F.col("members")), strict_int)
    vertex = F.explode(F.when(F.col("vertex").isNotNull(), F.array("vertex")).otherwise(listed)).alias("vertex")
    packed = _packed_ids(rows.select("part", vertex), "part", "vertex", segment_size)
    key = F.concat(padded(F.col("part"), n_parts), F.lit("-hash")).alias("key")
    staged = stored(packed.select(F.lit(None).cast("int").alias("vertex"), key, "segment", "members", "part"))
    ranged = staged.repartitionByRange("part", "segment").sortWithinPartitions("part", "segment")
    ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return stored_members(spark, path)


def unmerged_members(members: DataFrame, n_parts: int) -> DataFrame:
    """The member rows that :func:`merge_partitions_range` leaves in place."""
    return members.where(~F.col("part").between(0, n_parts - 1))


def merge_partitions_with_degree(members: DataFrame, n_parts: int, segment_size: int = SEGMENT_SIZE) -> DataFrame:
    """As :func:`merge_partitions` over members ``vertex degree``, which sort as texts."""
    text = F.col("vertex").cast("string")
    lists = segmented_lists(
        _in_range(members, n_parts).select("part", "vertex", "out_degree").distinct(),
        ["part"],
        ["part"],
        "vertex",
        [F.sort_array(F.collect_list(F.concat_ws(" ", "vertex", "out_degree"))).alias("_members")],
        order=text,
        block=F.substring(text, 1, _TEXT_BLOCK_DIGITS),
        size=segment_size,
    )
    return lists.select(_hash_key(), "segment", F.array_join("_members", " ").alias("members"))


def _hash_key() -> Column:
    return F.concat(F.lit("newhash"), F.col("part").cast("string")).alias("key")


def _in_range(members: DataFrame, n_parts: int) -> DataFrame:
    if n_parts < 1:
        raise ValueError("the number of partitions is 1 or more")
    return members.where(F.col("part").between(0, n_parts - 1))


def _packed_ids(rows: DataFrame, group: str, member: str, segment_size: int) -> DataFrame:
    order = unsigned_order(F.col(member))
    entry = F.struct(order.alias("order"), F.col(member).cast("string").alias("text"))
    lists = segmented_lists(
        rows.select(group, member).distinct(), [group], [group], member,
        [F.sort_array(F.collect_list(entry)).alias("_members")],
        order=order, block=F.shiftright(order, BLOCK_BITS), size=segment_size,
    )
    return lists.select(group, "segment", F.array_join("_members.text", " ").alias("members"))

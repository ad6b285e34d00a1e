"""Where intermediate tables go."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

SETTING = "spark.checkpoint.dir"
# Whether Spark deletes what a statement has shuffled when the statement ends, and not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Frames that are a stored table as it is, and the paths written for each application.
_tables: weakref.WeakSet[DataFrame] = weakref.WeakSet()
_paths: dict[str, list[str]] = {}
_names: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, the folder the context checkpoints to serves. Only a
    session that runs in one local process may have neither, and is then given
    a temporary folder.
    """
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if named:
        return named
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vertexweave-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own under the shared folder for what is written mid-query."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While a table is written, whose shuffles nothing reads again; a setting of the session's own is kept."""
    own = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, own)


def _by_differences(writer: DataFrameWriter) -> DataFrameWriter:
    """Numbers in order are written by their differences: about a byte for each entry of a sorted list of ids."""
    return writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")


def stored(df: DataFrame, lists: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    For what is read several times, or grows a plan hop by hop. The table
    outlives any executor, each reader takes only the columns it needs, and
    joins know its size. It stays until :func:`clear_scratch` is called; what
    was shuffled to make it does not. ``lists`` says that it holds sorted lists.
    """
    path = scratch_path(df.sparkSession, "table")
    with _shuffles_dropped(df.sparkSession):
        (_by_differences(df.write) if lists else df.write).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _tables.add(table)
    return table


def stored_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As :func:`stored`, in ``buckets`` files by a hash of ``key``, each sorted by it.

    Joins and aggregates on the key read them without a shuffle, if the other
    side comes in as many partitions. All rows of a key are in one bucket.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "buckets")
    name = "vertexweave_" + path.rsplit("-", 1)[1]
    # One file for each bucket: Spark deals rows to tasks by the same hash.
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    with _shuffles_dropped(spark):
        writer.option("path", path).format("parquet").saveAsTable(name)
    _names.setdefault(spark.sparkContext.applicationId, []).append(name)
    table = spark.table(name)
    _tables.add(table)
    return table


def is_stored(df: DataFrame) -> bool:
    """Whether ``df`` is what :func:`stored` returned, so that reading it twice is cheap."""
    return df in _tables


def is_committed(spark: SparkSession, path: str) -> bool:
    """Whether a job that wrote a table to ``path`` ended well."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def committed(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made and written if it is not there as a whole. It is no scratch and stays."""
    if not is_committed(spark, path):
        made = make()
        with _shuffles_dropped(spark):
            _by_differences(made.write).mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    _tables.add(table)
    return table


def clear_scratch(spark: SparkSession) -> int:
    """Delete all that this application wrote to the shared folder; returns the number of paths.

    Call it when no result is read any more. Nothing else in the folder is touched.
    """
    for name in _names.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"drop table if exists {name}")
    paths = _paths.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)

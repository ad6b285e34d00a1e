import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("vertexweave-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    return lambda *texts: spark.createDataFrame([(t,) for t in texts], "value string")


@pytest.fixture
def edge_frame(spark):
    return lambda pairs: spark.createDataFrame(pairs, "src int, dst int")


MICRO_LINES = ["# micro graph", "1 2", "2\t3", "3 1", "3 4", "4 4", "1 2"]


@pytest.fixture
def micro(lines):
    from vertexweave.sources import read_edges

    return read_edges(lines(*MICRO_LINES))


@pytest.fixture
def micro_raw(lines):
    from vertexweave.sources import read_edges_raw

    return read_edges_raw(lines(*MICRO_LINES))


def rows(df):
    """All rows as tuples, in order; nulls first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, v) for v in r))

"""Comparison of two results, with and without infinite values."""

import pytest
from conftest import rows

from vertexweave import operators as op, sources as io

CASES = [
    # first, second, (mismatches, missing in first, missing in second), matches, matches with infinity
    ("1:0 2:1 3:2", "1:0 2:1 3:2", (0, 0, 0), True, True),
    ("1:0 2:1 3:2", "1:0 2:5 3:2", (1, 0, 0), False, False),
    ("1:0 2:1", "1:0 3:9", (0, 1, 1), True, True),
    ("1:0 2:1", "1:0 2:1 3:2147483647", (0, 1, 0), False, True),
    ("1:0 1:7", "1:7", (0, 0, 0), True, True),
    ("1:0", "1:0 1:3 1:3", (2, 0, 0), False, False),
    ("1:2147483647 2:0", "1:2147483647 2:0", (0, 0, 0), True, False),
    ("1:4 2:0", "1:2147483647 2:0", (1, 0, 0), False, False),
    ("", "", (0, 0, 0), True, True),
]


@pytest.mark.parametrize("first,second,counts,plain,infinite", CASES)
def test_verdicts(spark, first, second, counts, plain, infinite):
    def values(text):
        pairs = [(i, *p.split(":")) for i, p in enumerate(text.split())]
        return spark.createDataFrame(pairs, "line int, vertex string, value string")

    for infinity, verdict in ((False, plain), (True, infinite)):
        report = op.compare_values(values(first), values(second).drop("line"), infinity=infinity).first()
        assert (report.mismatches, report.missing_in_first, report.missing_in_second) == counts
        assert report.matches is verdict
        assert report.second_vertices == len(second.split())


def test_first_side_without_order_must_be_unique(lines):
    second = io.read_vertex_values(lines("1 7"))
    with pytest.raises(Exception, match="more than one value"):
        op.compare_values(io.read_vertex_values(lines("1 0", "1 7")), second).collect()
    assert op.compare_values(io.read_vertex_values(lines("1 7", "1 7")), second).first().matches


def test_differences(lines):
    first = io.read_vertex_values(lines("1 0", "2 1"))
    second = io.read_vertex_values(lines("1 0", "2 5", "3 9", "2 5", "2 1"))
    assert rows(op.value_differences(first, second)) == [("2", "1", "5", 2), ("3", None, "9", 1)]

"""Line formats: what is read, left out, and refused."""

import pytest
from conftest import rows

from vertexweave import operators as op, sources as io

STRICT = {
    "# c": None, "  # x": None, "": None, "   ": None, "1 2": (1, 2), " 3\t4": (3, 4), "10\t\t11": (10, 11),
    "+9 -1": (9, -1), "5 5": None, "6 7 8": None, "99999999999 1": None, "ab 1": None, "1": None, "1.5 2": None,
    "-0 1": (0, 1), "2147483647 -2147483648": (2147483647, -2147483648), "2147483648 1": None, "1\f2": (1, 2),
    "\x0b1 2\x0b": (1, 2), "1 \x0b2": None, "1_0 2": None, "0x1 2": None, "1\n": None, "\x00 7 8 \x1f": (7, 8),
}


@pytest.mark.parametrize("text", STRICT)
def test_strict_edge_lines(lines, text):
    want = STRICT[text]
    assert rows(io.read_edges(lines(text))) == ([want] if want else [])


def test_raw_edge_lines(lines):
    assert rows(io.read_edges_raw(lines("# c", "5 5", " 1  2 ", "6 7 8", "", "9"))) == [(1, 2), (5, 5)]


@pytest.mark.parametrize("text", ["  # x", "99999999999 1", "ab 1", "1 1.5", "\x0b1 2"])
def test_raw_scan_fails(lines, text):
    with pytest.raises(Exception):
        io.read_edges_raw(lines(text)).collect()


def test_raw_second_token_is_read_on_demand(lines):
    edges = io.read_edges_raw(lines("1 abc", "1 2"))
    assert rows(op.out_degrees(edges)) == [(1, 2)]
    with pytest.raises(Exception):
        op.max_vertex_id(edges).collect()


def test_dictionary(lines, spark):
    assert rows(io.read_partition_dict(lines("1,4", "2,5", "1,4"))) == [(1, 4), (2, 5)]
    with pytest.raises(Exception, match="more than one part"):
        io.read_partition_dict(lines("1,4", "1,5")).collect()
    with pytest.raises(Exception):
        io.read_partition_dict(lines("1,x")).collect()


def test_dictionary_file_last_line_wins(spark, tmp_path):
    path = tmp_path / "dict.txt"
    path.write_text("".join(f"{i % 50},{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        found = rows(io.read_partition_dict(io.read_lines(spark, str(path))))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == [(v, 4950 + v) for v in range(50)]


def test_prepartitioned(lines):
    loaded = op.load_partitioned_adjacency(lines("% c", "  % c", "7,3,8\t9", "8,11,1"), 12)
    assert rows(loaded) == [("03-7", 3, 7, "8 9"), ("11-8", 11, 8, "1")]
    assert rows(op.load_partitioned_adjacency(lines("7,3,8"))) == [("03-7", 3, 7, "8")]
    for short in ("7,3", "7,3,"):
        with pytest.raises(Exception, match="no neighbour list"):
            op.load_partitioned_adjacency(lines(short), 12).collect()
        assert rows(op.load_partitioned_adjacency(lines(short), 12, strict=False)) == [("03-7", 3, 7, "")]
    with pytest.raises(Exception):
        op.load_partitioned_adjacency(lines("x,3,8"), 12).collect()


def test_positional(spark, tmp_path):
    path = tmp_path / "graph.txt"
    path.write_text("3\n1 2\n\n0 2 2\n")
    assert rows(io.positional_to_edges(spark, str(path))) == [(0, 1), (0, 2), (2, 0), (2, 2), (2, 2)]
    assert rows(io.positional_counts(spark, str(path))) == [(3, 3, True)]
    path.write_text("4\n1 2\n")
    assert rows(io.positional_counts(spark, str(path))) == [(4, 1, False)]
    for broken in ("4\n1 x\n", "four\n1 2\n", "\n1 2\n"):
        path.write_text(broken)
        with pytest.raises(Exception, match="not a 32-bit integer"):
            io.positional_to_edges(spark, str(path)).collect()


def test_positional_over_splits_and_files(spark, tmp_path):
    listed = [f"{i * 7 % 1000} {i}" if i % 3 else "" for i in range(3000)]
    whole = ["3000", *listed]
    for part, begin in enumerate(range(0, len(whole), 700)):
        (tmp_path / f"part-{part:05d}").write_text("\n".join(whole[begin:begin + 700]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        edges = rows(io.positional_to_edges(spark, str(tmp_path)))
        assert rows(io.positional_counts(spark, str(tmp_path))) == [(3000, 3000, True)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert edges == sorted((i, int(n)) for i, line in enumerate(listed) for n in line.split())


def test_vertex_values(lines):
    texts = lines("1 0", "2  x ", "3", "4 5 6", "")
    assert rows(io.read_vertex_values(texts)) == [("1", "0"), ("2", "x")]
    assert rows(io.rejected_value_lines(texts)) == [("",), ("3",), ("4 5 6",)]


def test_packed_blocks(lines):
    assert rows(io.read_blocks(lines("1 2 1 I 3 2 B", "4", "5 "))) == [
        (1, 2, 1, "I"), (1, 3, 2, "B"), (4, None, None, None), (5, None, None, None),
    ]
    with pytest.raises(Exception, match="broken block"):
        io.read_blocks(lines("1 2 1")).collect()


def test_hop_rows(lines):
    texts = lines("! 1 2 1 B", "@ 4", "! 1 2 1", "1 2", "@ 4 5", "! 3 1 2 I ")
    assert rows(io.read_hop_rows(texts)) == [(1, 2, 1, "B"), (3, 1, 2, "I"), (4, None, None, None)]


def test_written_tables_and_lines(spark, micro, tmp_path):
    io.write_table(op.partition_members(micro, 3), str(tmp_path / "members"), part="part")
    back = spark.read.schema("vertex int, part int").parquet(str(tmp_path / "members"))
    assert rows(back.select("part", "vertex")) == rows(op.partition_members(micro, 3))
    io.write_table(op.adjacency(micro, 3), str(tmp_path / "adjacency"))
    assert rows(spark.read.parquet(str(tmp_path / "adjacency"))) == rows(op.adjacency(micro, 3))
    io.write_edges(micro, str(tmp_path / "edges"))
    assert rows(io.read_edges(io.read_lines(spark, str(tmp_path / "edges")))) == rows(micro)
    io.write_lines(op.weighted_adjacency(micro), str(tmp_path / "weighted"), order=("vertex",))
    assert [r.value for r in spark.read.text(str(tmp_path / "weighted")).orderBy("value").collect()] == [
        "1\t2:1\t2:1", "2\t3:1", "3\t1:1\t4:1",
    ]


def test_report_lines(micro):
    report = io.stats_lines(op.block_stats(op.extended_vertex_blocks(micro, 1, 2, keep_lone=True)))
    assert [r.line for r in report.orderBy("position").collect()] == [
        "# anchor vertices: 4", "# total edges (in EVBs): 8", "# avg. edges per EVB: 2.0",
        "# min edges: 0 of anchor vertex 4", "# max edges: 3 of anchor vertex 2",
    ]


def test_positional_files_go_by_number(spark, tmp_path):
    (tmp_path / "part-99999").write_text("3\n1\n")
    (tmp_path / "part-100000").write_text("2\n\n0\n")
    found = io.positional_to_edges(spark, str(tmp_path))
    assert rows(found.select("vertex", "neighbor")) == [(0, 1), (1, 2), (3, 0)]


@pytest.mark.parametrize("other", ["piece-2", "rest"])
def test_positional_files_of_mixed_names_fail(spark, tmp_path, other):
    (tmp_path / "part-1").write_text("1\n0\n")
    (tmp_path / other).write_text("0\n")
    with pytest.raises(Exception, match="file names of different forms"):
        io.positional_to_edges(spark, str(tmp_path)).collect()


def test_positional_files_without_numbers_go_by_name(spark, tmp_path):
    (tmp_path / "rest.txt").write_text("0 1\n")
    (tmp_path / "begin.txt").write_text("2\n1\n")
    assert rows(io.positional_to_edges(spark, str(tmp_path))) == [(0, 1), (1, 0), (1, 1)]

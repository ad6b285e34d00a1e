"""SQL for the results of ``queries``, written from the rules rather than from the plans.

Blocks, for one, are built here by the literal rule, hop by hop with all
repeats and then merged, while the library searches without repeats.
"""

from __future__ import annotations

G1_RAW = "SELECT CAST(l_partkey AS INT) AS src, CAST(l_suppkey AS INT) AS dst FROM lineitem"
G1 = f"{G1_RAW} WHERE l_partkey <> l_suppkey"
G2 = (
    "SELECT CAST(a.o_custkey AS INT) AS src, CAST(b.o_custkey AS INT) AS dst FROM orders a"
    " JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_custkey <> b.o_custkey"
)
G3 = (
    "SELECT CAST(c_custkey + 1000 AS INT) AS src, CAST(c_nationkey + 100 AS INT) AS dst FROM customer"
    " UNION ALL SELECT CAST(n_nationkey + 100 AS INT), CAST(n_regionkey AS INT) FROM nation"
)
UNIVERSE = "SELECT src AS vertex FROM e UNION SELECT dst FROM e"
SUPPLIERS = "SELECT CAST(s_suppkey AS INT) AS vertex FROM supplier"


def _neighbors(mode: int) -> str:
    out = "SELECT src AS vertex, dst AS neighbor FROM e"
    back = "SELECT dst AS vertex, src AS neighbor FROM e"
    return {1: out, 2: back, 3: f"{out} UNION ALL {back}"}[mode]


def _hop(hop: int) -> str:
    """One literal extension of the rows in ``h<hop - 1>``."""
    border = f"(SELECT DISTINCT anchor, vertex FROM h{hop - 1} WHERE type = 'B')"
    return (
        f"SELECT anchor, vertex, {hop - 1} AS distance, 'I' AS type FROM {border}"
        " WHERE vertex IN (SELECT vertex FROM nb) UNION ALL"
        f" SELECT b.anchor, nb.neighbor, {hop}, 'B' FROM {border} b JOIN nb ON nb.vertex = b.vertex"
        " WHERE b.anchor <> nb.neighbor"
    )


def _hops(graph: str, mode: int, k: int) -> str:
    ctes = [f"e AS ({graph})", f"nb AS (SELECT DISTINCT vertex, neighbor FROM ({_neighbors(mode)}))"]
    ctes.append(
        "h1 AS (SELECT vertex AS anchor, neighbor AS vertex, 1 AS distance, 'B' AS type"
        f" FROM ({_neighbors(mode)}))"
    )
    ctes += [f"h{hop} AS ({_hop(hop)})" for hop in range(2, k + 1)]
    return "WITH " + ", ".join(ctes)


def _blocks(graph: str, mode: int, k: int, lone: bool = False) -> str:
    rows = " UNION ALL ".join(f"SELECT * FROM h{hop}" for hop in range(1, k + 1))
    merged = (
        "SELECT anchor, vertex, min(distance) AS distance,"
        f" CASE WHEN bool_and(type = 'B') THEN 'B' ELSE 'I' END AS type FROM ({rows}) GROUP BY anchor, vertex"
    )
    if lone:
        merged += (
            f" UNION ALL SELECT vertex, NULL, NULL, NULL FROM ({UNIVERSE})"
            " WHERE vertex NOT IN (SELECT vertex FROM nb)"
        )
    return f"{_hops(graph, mode, k)}, blocks AS ({merged})"


def _all_blocks(graph: str, mode: int, k: int, lone: bool = False) -> str:
    return f"{_blocks(graph, mode, k, lone)} SELECT * FROM blocks"


def _segments(rows: str, group: str, order: str, size: int) -> str:
    """Number the rows of each group in order, and the lists of ``size`` they fall into."""
    return (
        f"SELECT *, CAST((row_number() OVER (PARTITION BY {group} ORDER BY {order}) - 1) // {size} AS INT)"
        f" AS segment FROM ({rows})"
    )


def _packed_blocks(size: int) -> str:
    return (
        f"{_blocks(G2, 1, 2)} SELECT anchor, segment, anchor || ' ' ||"
        " string_agg(vertex || ' ' || distance || ' ' || type, ' ' ORDER BY vertex) AS line"
        f" FROM ({_segments('SELECT * FROM blocks', 'anchor', 'vertex', size)}) GROUP BY anchor, segment"
    )


def _adjacency(mode: int, size: int) -> str:
    sides = {1: ["out"], 2: ["in"], 3: ["out", "in"]}[mode]
    rows = {
        "out": "SELECT DISTINCT src AS vertex, 'out' AS side, dst AS neighbor FROM e",
        "in": "SELECT DISTINCT dst AS vertex, 'in' AS side, src AS neighbor FROM e",
    }
    listed = " UNION ALL ".join(rows[s] for s in sides)
    lists = ", ".join(
        f"coalesce(string_agg(CASE WHEN side = '{s}' THEN CAST(neighbor AS VARCHAR) END, ' ' ORDER BY neighbor), '')"
        f' AS "{s}"'
        for s in sides
    )
    present = f"SELECT vertex, 'none', NULL, 0 FROM ({UNIVERSE})"
    return (
        f"WITH e AS ({G1}) SELECT vertex, segment, {lists}"
        f" FROM ({_segments(listed, 'vertex, side', 'neighbor', size)} UNION ALL {present})"
        " GROUP BY vertex, segment"
    )


def _long(graph: str, mode: int) -> str:
    return (
        f"WITH e AS ({graph}), nb AS (SELECT DISTINCT * FROM ({_neighbors(mode)})),"
        f" long AS (SELECT * FROM nb UNION ALL SELECT vertex, -1 FROM ({UNIVERSE})"
        " WHERE vertex NOT IN (SELECT vertex FROM nb))"
    )


def _members(n: int) -> str:
    return (
        f"WITH e AS ({G1}), members AS (SELECT CAST(u.vertex % {n} AS INT) AS part, u.vertex,"
        " CAST(coalesce(d.n, 0) AS BIGINT) AS out_degree"
        f" FROM ({UNIVERSE}) u LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM e GROUP BY src) d"
        " ON d.src = u.vertex)"
    )


def _partitioned(mode: int, regions: bool = True) -> str:
    sides = {1: ["out"], 2: ["in"], 3: ["out", "in"]}[mode]
    known = "" if regions else " WHERE vertex NOT IN (SELECT r_regionkey FROM region)"
    lists = {
        "out": "SELECT src AS vertex, string_agg(dst || '-' || coalesce(CAST(part AS VARCHAR), 'null'), ' '"
        " ORDER BY dst) AS list FROM (SELECT DISTINCT src, dst FROM e) LEFT JOIN dict ON dict.vertex = dst GROUP BY src",
        "in": "SELECT dst AS vertex, string_agg(CAST(src AS VARCHAR), ' ' ORDER BY src) AS list"
        " FROM (SELECT DISTINCT src, dst FROM e) GROUP BY dst",
    }
    columns = ", ".join(f"coalesce(l_{s}.list, '') AS \"{s}\"" for s in sides)
    joins = " ".join(f"LEFT JOIN ({lists[s]}) l_{s} ON l_{s}.vertex = u.vertex" for s in sides)
    return (
        f"WITH e AS ({G3}), dict AS (SELECT vertex, CAST(vertex % 12 AS INT) AS part FROM ({UNIVERSE}){known})"
        " SELECT printf('%02d-%d', d.part, u.vertex) AS key, d.part, u.vertex, 0 AS segment,"
        f" {columns} FROM ({UNIVERSE}) u LEFT JOIN dict d ON d.vertex = u.vertex {joins}"
    )


def _partitioned_segments(size: int) -> str:
    out = "SELECT DISTINCT src AS vertex, 'out' AS side, dst AS neighbor, dst || '-' || dst % 12 AS entry FROM e"
    back = "SELECT DISTINCT dst, 'in', src, CAST(src AS VARCHAR) FROM e"
    lists = ", ".join(
        f"coalesce(string_agg(CASE WHEN side = '{s}' THEN entry END, ' ' ORDER BY neighbor), '') AS \"{s}\""
        for s in ("out", "in")
    )
    rows = _segments(f"{out} UNION ALL {back}", "vertex, side", "neighbor", size)
    return (
        f"WITH e AS ({G3}) SELECT printf('%02d-%d', vertex % 12, vertex) AS key, CAST(vertex % 12 AS INT) AS part,"
        f" vertex, segment, {lists} FROM ({rows}) GROUP BY vertex, segment"
    )


def _packed_members(key: str, size: int, text: str = "CAST(vertex AS VARCHAR)", order: str = "vertex", parts: int = 10) -> str:
    rows = _segments("SELECT * FROM members WHERE part BETWEEN 0 AND 9", "part", order, size)
    return (
        f"{_members(parts)} SELECT {key} AS key, segment, string_agg({text}, ' ' ORDER BY {order}) AS members"
        f" FROM ({rows}) GROUP BY part, segment"
    )


def _packed_rows(graph: str, mode: int, keys: str, size: int) -> str:
    # As stored bytes, negative ids sort last.
    order = "neighbor < 0, neighbor"
    rows = _segments(f"SELECT * FROM long WHERE vertex IN ({keys})", "vertex", order, size)
    return (
        f"{_long(graph, mode)} SELECT 'new' || vertex AS key, segment,"
        f" string_agg(CAST(neighbor AS VARCHAR), ' ' ORDER BY {order}) AS members"
        f" FROM ({rows}) GROUP BY vertex, segment"
    )


def _weighted(graph: str, size: int, sinks: bool = False) -> str:
    rows = _segments("SELECT src, dst FROM e", "src", "dst", size)
    sql = (
        f"WITH e AS ({graph}) SELECT src AS vertex, segment,"
        " src || string_agg(chr(9) || dst || ':1', '' ORDER BY dst) AS line"
        f" FROM ({rows}) GROUP BY src, segment"
    )
    if sinks:
        sql += f" UNION ALL SELECT vertex, 0, CAST(vertex AS VARCHAR) FROM ({UNIVERSE}) WHERE vertex NOT IN (SELECT src FROM e)"
    return sql


def _stats(graph: str, mode: int, k: int, lone: bool = False) -> str:
    return (
        f"{_blocks(graph, mode, k, lone)}, sizes AS (SELECT anchor, count(vertex) AS n FROM blocks GROUP BY anchor),"
        " stats AS (SELECT count(*) AS anchors, CAST(sum(n) AS BIGINT) AS total_entries, avg(n) AS mean_entries,"
        " (SELECT n FROM sizes ORDER BY n, anchor LIMIT 1) AS min_entries,"
        " (SELECT anchor FROM sizes ORDER BY n, anchor LIMIT 1) AS min_anchor,"
        " (SELECT n FROM sizes ORDER BY n DESC, anchor LIMIT 1) AS max_entries,"
        " (SELECT anchor FROM sizes ORDER BY n DESC, anchor LIMIT 1) AS max_anchor FROM sizes)"
    )


def _degrees() -> str:
    return f"WITH deg AS (SELECT src AS vertex, count(*) AS out_degree FROM ({G1_RAW}) GROUP BY src)"


def _by_degree(size: int) -> str:
    rows = _segments("SELECT * FROM deg", "out_degree", "vertex", size)
    return (
        f"{_degrees()} SELECT out_degree, segment, string_agg(CAST(vertex AS VARCHAR), ' ' ORDER BY vertex) AS vertices"
        f" FROM ({rows}) GROUP BY out_degree, segment"
    )


def _value_lines() -> str:
    lines = (
        "lines AS (SELECT o_orderkey AS line, CAST(o_custkey AS VARCHAR) AS vertex, o_orderpriority AS one,"
        " CASE WHEN o_orderstatus = 'F' THEN '2147483647' ELSE o_orderpriority END AS two FROM orders)"
    )
    first = (
        "first_side AS (SELECT vertex, arg_max(one, line) AS first_value FROM lines"
        " WHERE one NOT LIKE '% %' GROUP BY vertex)"
    )
    return f"WITH {lines}, {first}, second_side AS (SELECT vertex, two AS second_value FROM lines WHERE two NOT LIKE '% %')"


def _compared(infinity: bool) -> str:
    discount = "second_infinite" if infinity else "0"
    return (
        f"{_value_lines()}, counts AS (SELECT (SELECT count(*) FROM first_side) AS first_vertices,"
        " count(*) AS second_vertices, count(*) FILTER (second_value = '2147483647') AS second_infinite,"
        " count(*) FILTER (first_value IS NOT NULL AND first_value <> second_value) AS mismatches,"
        " count(*) FILTER (first_value IS NULL) AS missing_in_first,"
        " (SELECT count(*) FROM first_side WHERE vertex NOT IN (SELECT vertex FROM second_side)) AS missing_in_second"
        " FROM second_side LEFT JOIN first_side USING (vertex))"
        f" SELECT *, first_vertices = second_vertices - {discount} AND mismatches = 0 AS matches FROM counts"
    )


_LINE_CASES = """WHEN 1 THEN l_partkey || ' ' || l_suppkey
 WHEN 2 THEN '  ' || l_partkey || chr(9) || chr(9) || l_suppkey || ' '
 WHEN 3 THEN '+' || l_partkey || ' -' || l_suppkey
 WHEN 4 THEN '# ' || l_partkey || ' ' || l_suppkey
 WHEN 5 THEN l_partkey || ' ' || l_suppkey || ' ' || l_linenumber
 WHEN 6 THEN l_partkey || ' ' || l_partkey"""


def _edge_lines(last: str) -> str:
    return f"WITH lines AS (SELECT CASE l_linenumber {_LINE_CASES} ELSE {last} END AS value FROM lineitem)"


def _edges_strict() -> str:
    bad = "l_partkey || CASE WHEN l_returnflag = 'N' THEN ' 99999999999' ELSE ' x' END || l_suppkey"
    return (
        f"{_edge_lines(bad)}, words AS (SELECT regexp_split_to_array(trim(value, ' ' || chr(9)), '[ \\t]+') AS w"
        " FROM lines WHERE NOT starts_with(trim(value), '#')), pairs AS (SELECT"
        " CASE WHEN regexp_full_match(w[1], '[+-]?[0-9]+') THEN TRY_CAST(w[1] AS INT) END AS src,"
        " CASE WHEN regexp_full_match(w[2], '[+-]?[0-9]+') THEN TRY_CAST(w[2] AS INT) END AS dst"
        " FROM words WHERE len(w) = 2) SELECT src, dst FROM pairs WHERE src <> dst"
    )


def _edges_raw() -> str:
    return (
        f"{_edge_lines('l_partkey || chr(32) || l_suppkey')}, words AS (SELECT"
        " regexp_split_to_array(trim(value, ' ' || chr(9)), '[ \\t]+') AS w FROM lines WHERE NOT starts_with(value, '#'))"
        " SELECT CAST(w[1] AS INT) AS src, CAST(w[2] AS INT) AS dst FROM words WHERE len(w) = 2"
    )


_POSITIONAL = (
    "SELECT CAST(a.o_orderkey AS INT) AS vertex, CAST(a.o_custkey AS INT) AS neighbor FROM orders a"
    " WHERE a.o_orderstatus <> 'F' UNION ALL SELECT CAST(a.o_orderkey AS INT), CAST(b.o_custkey AS INT)"
    " FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderstatus <> 'F'"
)


def _edge_rejects() -> str:
    """Lines by shape: the fourth is a comment, the fifth has three tokens, the seventh a bad number."""
    shapes = {
        "comment": "l_linenumber = 4",
        "edge to itself": "l_linenumber = 6 OR (l_linenumber IN (1, 2) AND l_partkey = l_suppkey)",
        "not a 32-bit integer": "l_linenumber = 7",
        "not two tokens": "l_linenumber = 5",
    }
    counts = [f"SELECT '{reason}' AS reason, count(*) FILTER ({which}) AS lines FROM lineitem" for reason, which in shapes.items()]
    return " UNION ALL ".join(counts)


def oracle_sql() -> dict[str, str]:
    e1, e3 = f"WITH e AS ({G1})", f"WITH e AS ({G3})"
    suppliers_only = f"vertex IN ({SUPPLIERS})"
    new_hash = "'newhash' || part"
    with_degree = "vertex || ' ' || out_degree"
    text_order = "CAST(vertex AS VARCHAR)"
    whole = 100_000
    return {
        "edges_strict": _edges_strict(),
        "edge_rejects": _edge_rejects(),
        "hop_rejects": (
            "SELECT 'neither ! nor @' AS reason, count(*) FILTER (l_linenumber <> 4) AS lines FROM lineitem UNION ALL"
            " SELECT 'wrong number of tokens', count(*) FILTER (l_linenumber = 4) FROM lineitem"
        ),
        "edges_raw": _edges_raw(),
        "edges_file": G1,
        "partition_dict": (
            "SELECT CAST(o_custkey AS INT) AS vertex, CAST(arg_max(o_orderkey % 12, o_orderkey) AS INT) AS part"
            " FROM orders GROUP BY o_custkey"
        ),
        "vertex_values": (
            "SELECT CAST(o_custkey AS VARCHAR) AS vertex, o_orderpriority AS value FROM orders"
            " WHERE o_orderpriority NOT LIKE '% %'"
        ),
        "rejected_values": "SELECT o_custkey || ' ' || o_orderpriority AS value FROM orders WHERE o_orderpriority LIKE '% %'",
        "blocks_roundtrip": _all_blocks(G3, 1, 1, lone=True),
        "hop_rows_roundtrip": _all_blocks(G3, 1, 3, lone=True),
        "positional_to_edges": _POSITIONAL,
        "positional_plain_names": _POSITIONAL,
        "positional_counts": (
            "SELECT CAST(count(*) AS INT) AS declared, count(*) AS actual, TRUE AS agrees FROM orders"
        ),
        "neighbors_out": f"{e1} {_neighbors(1)}",
        "neighbors_in": f"{e1} {_neighbors(2)}",
        "neighbors_both": f"{e1} {_neighbors(3)}",
        "neighbors_distinct": f"{e1} SELECT DISTINCT * FROM ({_neighbors(1)})",
        "vertices": f"{e1} {UNIVERSE}",
        "lone_vertices": f"{e1} SELECT vertex FROM ({UNIVERSE}) WHERE vertex NOT IN (SELECT dst FROM e)",
        "vertex_blocks": f"{_hops(G2, 1, 1)} SELECT * FROM h1",
        "expand_hop2": f"{_hops(G2, 1, 2)} SELECT * FROM h2",
        "expand_hop2_both": f"{_hops(G2, 3, 2)} SELECT * FROM h2",
        "expand_hop2_tiled_both": f"{_hops(G2, 3, 2)} SELECT * FROM h2",
        "expand_hop2_tiled": (
            f"WITH e AS ({G1}), nb AS (SELECT DISTINCT vertex, neighbor FROM ({_neighbors(3)})),"
            " h1 AS (SELECT src AS anchor, dst AS vertex, 1 AS distance, 'B' AS type FROM e)"
            f" SELECT * FROM ({_hop(2)})"
        ),
        "merge_hops": _all_blocks(G2, 1, 2),
        "evb_k1_both": _all_blocks(G1, 3, 1),
        "evb_k2_out": _all_blocks(G2, 1, 2),
        "evb_k2_in": _all_blocks(G2, 2, 2),
        "evb_k2_both": _all_blocks(G2, 3, 2),
        "evb_k2_hubs": _all_blocks(G1, 1, 2),
        "evb_k2_hubs_both_whole": _all_blocks(G1, 3, 2),
        "evb_k2_hubs_tiled_whole": _all_blocks(G1, 3, 2),
        "evb_k2_hubs_bitmaps": _all_blocks(G1, 3, 2),
        "evb_k3_bitmaps": _all_blocks(G2, 1, 3),
        "evb_k3_bitmaps_lone": _all_blocks(G3, 1, 3, lone=True),
        "evb_k3_resumed": _all_blocks(G2, 1, 3),
        "evb_k2_in_lone": _all_blocks(G1, 2, 2, lone=True),
        "evb_k3_out": _all_blocks(G2, 1, 3),
        "evb_k3_sinks": _all_blocks(G3, 1, 3),
        "evb_k3_sinks_lone": _all_blocks(G3, 1, 3, lone=True),
        "evb_k2_tree_in": _all_blocks(G3, 2, 2),
        "evb_packed": _packed_blocks(whole),
        "evb_packed_segments": _packed_blocks(50),
        "adjacency_out": _adjacency(1, whole),
        "adjacency_in": _adjacency(2, whole),
        "adjacency_both": _adjacency(3, whole),
        "adjacency_segments": _adjacency(3, 20),
        "adjacency_long_out": f"{_long(G3, 1)} SELECT * FROM long",
        "adjacency_long_in": f"{_long(G1, 2)} SELECT * FROM long",
        "adjacency_long_both": f"{_long(G1, 3)} SELECT * FROM long",
        "partition_members": f"{_members(10)} SELECT part, vertex FROM members",
        "partition_members_degree": f"{_members(10)} SELECT * FROM members",
        "adjacency_partitioned_out": _partitioned(1),
        "adjacency_partitioned_in": _partitioned(2),
        "adjacency_partitioned_both": _partitioned(3),
        "adjacency_partitioned_unmapped": _partitioned(1, regions=False),
        "adjacency_partitioned_segments": _partitioned_segments(7),
        "load_partitioned_adjacency": (
            "SELECT printf('%02d-%d', o_custkey % 12, o_orderkey) AS key, CAST(o_custkey % 12 AS INT) AS part,"
            " CAST(o_orderkey AS INT) AS vertex, o_custkey || ' ' || o_orderkey AS out FROM orders"
            " WHERE o_orderstatus <> 'F'"
        ),
        "load_partitioned_repeats": (
            "SELECT printf('%02d-%d', o_custkey % 12, o_custkey) AS key, CAST(o_custkey % 12 AS INT) AS part,"
            " CAST(o_custkey AS INT) AS vertex, CAST(max(o_orderkey) AS VARCHAR) AS out FROM orders GROUP BY o_custkey"
        ),
        "merge_row": _packed_rows(G1, 2, SUPPLIERS, whole),
        "merge_row_segments": _packed_rows(G1, 2, SUPPLIERS, 100),
        "merge_row_string_key": (
            f"SELECT 'newv' || substr(key, 4) AS key, segment, members FROM ({_packed_rows(G1, 2, SUPPLIERS, whole)})"
        ),
        "merge_row_no_neighbor": f"{e3} SELECT 'new' || dst AS key, 0 AS segment, '-1' AS members FROM e"
        " WHERE dst NOT IN (SELECT src FROM e) GROUP BY dst",
        "merge_partitions": _packed_members(new_hash, whole),
        "merge_partitions_repeats": _packed_members(new_hash, whole),
        "merge_partitions_degree_repeats": _packed_members(new_hash, whole, with_degree, text_order),
        "merge_partitions_segments": _packed_members(new_hash, 64),
        "merge_partitions_degree": _packed_members(new_hash, whole, with_degree, text_order),
        "merge_partitions_degree_segments": _packed_members(new_hash, 64, with_degree, text_order),
        "merge_partitions_range": _packed_members("part || '-hash'", whole),
        "unmerged_members": f"{_members(25)} SELECT part, vertex FROM members WHERE part > 9",
        "replace_members": (
            "SELECT CAST(NULL AS INT) AS vertex, key, segment, members, CAST(split_part(key, '-', 1) AS INT) AS part"
            f" FROM ({_packed_members("part || '-hash'", whole, parts=25)}) UNION ALL"
            f" (WITH e AS ({G1}) SELECT vertex, NULL, NULL, NULL, CAST(vertex % 25 AS INT) FROM ({UNIVERSE})"
            " WHERE vertex % 25 > 9)"
        ),
        "region_read_back": (
            f"{e1}, u AS ({UNIVERSE}), top AS (SELECT max(vertex) AS id FROM u)"
            " SELECT * FROM (SELECT vertex, CAST(least(vertex // ((SELECT id FROM top) // 8), 7) AS INT) AS region FROM u)"
            " WHERE region = 3"
        ),
        "region_uniform": (
            f"{e1}, u AS ({UNIVERSE}), top AS (SELECT max(vertex) AS id FROM u)"
            " SELECT vertex, CAST(least(vertex // ((SELECT id FROM top) // 8), 7) AS INT) AS region FROM u"
        ),
        "region_hash": (
            f"{_members(10)} SELECT part, vertex, CAST((part >= 2)::INT + (part >= 4)::INT + (part >= 6)::INT AS INT)"
            " AS region FROM members"
        ),
        "region_hash_sparse": (
            f"{_members(7)}, bounds AS (SELECT CAST(i AS VARCHAR) || '-' AS bound FROM range(1, 12) r(i))"
            " SELECT part, vertex, CAST((SELECT count(*) FROM bounds WHERE bound <= part || '-' || vertex) AS INT)"
            " AS region FROM members"
        ),
        "region_hash_beyond": (
            f"{_members(40)}, bounds AS (SELECT CAST(i AS VARCHAR) || '-' AS bound FROM range(1, 12) r(i))"
            " SELECT part, vertex, CAST((SELECT count(*) FROM bounds WHERE bound <= part || '-' || vertex) AS INT)"
            " AS region FROM members"
        ),
        "lookup_members": f"{_long(G1, 3)} SELECT * FROM long WHERE {suppliers_only}",
        "read_members": (
            f"{_long(G1, 1)} SELECT * FROM long WHERE neighbor IN (SELECT r_regionkey * 17 + 1 FROM region)"
        ),
        "lookup_stored_members": (
            f"{_members(25)} SELECT vertex, out_degree, part FROM members WHERE part IN (SELECT r_regionkey FROM region)"
        ),
        "lookup_column": f"{e1} SELECT DISTINCT vertex, neighbor FROM ({_neighbors(2)}) WHERE {suppliers_only}",
        "lookup_packed": (
            f"{_members(10)} SELECT 'newhash' || part AS key, vertex AS neighbor FROM members"
            " WHERE part IN (SELECT r_regionkey FROM region) AND part BETWEEN 0 AND 9"
        ),
        "lookup_partitioned_key": (
            f"{e3} SELECT DISTINCT printf('%02d-%d', dst % 12, dst) AS key, src AS neighbor FROM e"
            " WHERE dst IN (SELECT n_nationkey + 100 FROM nation)"
        ),
        "lookup_prepartitioned": (
            "WITH rows AS (SELECT CAST(o_orderkey AS INT) AS vertex, o_custkey, o_orderkey FROM orders"
            " WHERE o_orderstatus <> 'F') SELECT vertex, CAST(o_custkey AS INT) AS neighbor FROM rows"
            f" WHERE {suppliers_only} UNION ALL SELECT vertex, CAST(o_orderkey AS INT) FROM rows WHERE {suppliers_only}"
        ),
        "weighted_adjacency": _weighted(G1, whole),
        "weighted_adjacency_sinks": _weighted(G3, whole, sinks=True),
        "weighted_adjacency_segments": _weighted(G1, 10),
        "neighbor_arrays": (
            f"{e1} SELECT CAST(vertex AS VARCHAR) AS vertex, 0 AS segment,"
            " coalesce(string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst), '') AS neighbors"
            f" FROM ({UNIVERSE}) LEFT JOIN e ON src = vertex GROUP BY vertex"
        ),
        "block_stats": f"{_stats(G2, 1, 2)} SELECT * FROM stats",
        "block_stats_lone": f"{_stats(G3, 1, 2, lone=True)} SELECT * FROM stats",
        "block_stats_report": (
            f"{_stats(G3, 1, 1)} SELECT 0 AS position, '# anchor vertices: ' || anchors AS line FROM stats"
            " UNION ALL SELECT 1, '# total edges (in EVBs): ' || total_entries FROM stats"
            " UNION ALL SELECT 2, '# avg. edges per EVB: ' || mean_entries FROM stats"
            " UNION ALL SELECT 3, '# min edges: ' || min_entries || ' of anchor vertex ' || min_anchor FROM stats"
            " UNION ALL SELECT 4, '# max edges: ' || max_entries || ' of anchor vertex ' || max_anchor FROM stats"
        ),
        "top_out_degree": f"{_degrees()} SELECT * FROM deg ORDER BY out_degree DESC, vertex LIMIT 5",
        "out_degree_histogram": f"{_degrees()} SELECT out_degree, count(*) AS vertices FROM deg GROUP BY out_degree",
        "vertices_by_out_degree": _by_degree(whole),
        "vertices_by_out_degree_segments": _by_degree(16),
        "max_vertex_id": f"SELECT greatest(max(src), max(dst), -1) AS max_vertex_id FROM ({G1_RAW})",
        "compare_values": _compared(False),
        "compare_values_inf": _compared(True),
        "compare_two_plans": (
            f"{_blocks(G2, 1, 2)} SELECT count(*) AS first_vertices, count(*) AS second_vertices,"
            " CAST(0 AS BIGINT) AS second_infinite, CAST(0 AS BIGINT) AS mismatches,"
            " CAST(0 AS BIGINT) AS missing_in_first, CAST(0 AS BIGINT) AS missing_in_second, TRUE AS matches FROM blocks"
        ),
        "value_differences": (
            f"{_value_lines()} SELECT vertex, first_value, second_value, count(*) AS second_rows FROM second_side"
            " LEFT JOIN first_side USING (vertex) WHERE first_value IS DISTINCT FROM second_value"
            " GROUP BY vertex, first_value, second_value"
        ),
    }

from vertexweave.sources.dictionary import read_partition_dict
from vertexweave.sources.edges import edges_from_columns, read_edges, read_edges_raw, read_edges_reported
from vertexweave.sources.lines import read_lines
from vertexweave.sources.packed import read_blocks, read_hop_rows, read_hop_rows_reported, rejects
from vertexweave.sources.positional import positional_counts, positional_to_edges
from vertexweave.sources.sinks import hop_lines, stats_lines, write_edges, write_lines, write_regions, write_table
from vertexweave.sources.values import read_vertex_values, rejected_value_lines

__all__ = [
    "edges_from_columns", "hop_lines", "positional_counts", "positional_to_edges", "read_blocks", "read_edges",
    "read_edges_raw", "read_edges_reported", "read_hop_rows", "read_hop_rows_reported", "read_lines", "read_partition_dict", "read_vertex_values",
    "rejected_value_lines", "rejects", "stats_lines", "write_edges", "write_lines", "write_regions", "write_table",
]

from vertexweave.operators.blocks import (
    bitmap_blocks, expand_hop, extended_vertex_blocks, merge_hops, pack_blocks, vertex_blocks,
)
from vertexweave.operators.compare import compare_values, value_differences
from vertexweave.operators.export import neighbor_arrays, weighted_adjacency
from vertexweave.operators.layout import assign_region_hash, assign_region_uniform
from vertexweave.operators.lookup import lookup_column, lookup_members, read_members
from vertexweave.operators.neighbors import distinct_neighbors, lone_vertices, neighbors, vertices
from vertexweave.operators.pack import (
    merge_partitions, merge_partitions_range, merge_partitions_with_degree, merge_row, replace_members,
)
from vertexweave.operators.stats import (
    block_stats, max_vertex_id, out_degree_histogram, out_degrees, top_out_degree, vertices_by_out_degree,
)
from vertexweave.operators.store import (
    adjacency, adjacency_long, adjacency_partitioned, load_partitioned_adjacency, partition_members,
    partition_members_with_degree,
)

__all__ = [
    "adjacency", "adjacency_long", "adjacency_partitioned", "assign_region_hash", "assign_region_uniform",
    "bitmap_blocks", "block_stats", "compare_values", "distinct_neighbors", "expand_hop", "extended_vertex_blocks",
    "load_partitioned_adjacency", "lone_vertices", "lookup_column", "lookup_members", "max_vertex_id",
    "merge_hops", "merge_partitions", "merge_partitions_range", "merge_partitions_with_degree", "merge_row",
    "neighbor_arrays", "neighbors", "out_degree_histogram", "out_degrees", "pack_blocks", "partition_members",
    "partition_members_with_degree", "read_members", "replace_members", "top_out_degree", "value_differences", "vertex_blocks", "vertices",
    "vertices_by_out_degree", "weighted_adjacency",
]

"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local threads.
Each query is run to a sink that takes every row and keeps none: once to warm
up, then ``BENCH_RUNS`` times (default 3), of which the best counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from vertexweave import operators as op
from vertexweave.catalog import queries
from vertexweave.catalog.graphs import g1, g2, g3
from vertexweave.plans.storage import clear_scratch



def hub_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to suppliers, five times over, and one more vertex that starts a third of all edges."""
    edges = g1(spark, sf_dir)
    spread = edges.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(4))))
    near = spread.select((F.col("src") + 100_000 * F.col("copy")).cast("int").alias("src"), "dst")
    part = spread.where(F.col("dst") % 2 == 0)
    far = part.select(
        F.lit(-7).alias("src"),
        ((F.col("src") * 31 + F.col("dst") * 7919 + F.col("copy") * 104_729) % 2_000_003).cast("int").alias("dst"),
    )
    return near.unionByName(far)


HEADLINE = {
    "evb_k2_out_g2": lambda s, d: op.extended_vertex_blocks(g2(s, d), 1, 2),
    "evb_k2_both_g2": lambda s, d: op.extended_vertex_blocks(g2(s, d), 3, 2),
    "evb_k3_out_g3": lambda s, d: op.extended_vertex_blocks(g3(s, d), 1, 3),
    "adjacency_hub": lambda s, d: op.adjacency(hub_graph(s, d), 3),
    "weighted_adjacency_hub": lambda s, d: op.weighted_adjacency(hub_graph(s, d)),
    "neighbors_distinct_g1": lambda s, d: op.distinct_neighbors(g1(s, d), 1),
    **{
        name: queries()[name]
        for name in (
            "edges_strict", "expand_hop2", "evb_packed", "adjacency_both", "adjacency_long_in",
            "adjacency_partitioned_both", "partition_members_degree", "merge_partitions_degree", "merge_row",
            "lookup_column", "weighted_adjacency", "neighbor_arrays", "positional_to_edges", "block_stats",
            "top_out_degree", "vertices_by_out_degree", "max_vertex_id", "compare_values", "value_differences",
        )
    },
}


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vertexweave-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="vertexweave-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or list(HEADLINE)
    seconds = {}
    for name in wanted:
        run(HEADLINE[name](spark, sf_dir))
        times = []
        for _ in range(runs):
            begin = time.perf_counter()
            run(HEADLINE[name](spark, sf_dir))
            times.append(time.perf_counter() - begin)
        seconds[name] = round(min(times), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
        clear_scratch(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()

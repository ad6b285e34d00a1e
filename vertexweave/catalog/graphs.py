"""Graphs and text lines that the test tables hold.

* G1, parts to suppliers: repeated edges, edges to oneself, hubs.
* G2, customers of consecutive orders: sparse, several hops.
* G3, customers to nations to regions: a hierarchy with true sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vertexweave.sources import edges_from_columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def g1(spark: SparkSession, sf_dir: str, raw: bool = False) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return edges_from_columns(items, F.col("l_partkey"), F.col("l_suppkey"), keep_self=raw)


def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    this = orders.select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.col("o_custkey").alias("this_cust"))
    pairs = this.join(orders.select("o_orderkey", F.col("o_custkey").alias("next_cust")), "o_orderkey")
    return edges_from_columns(pairs, F.col("this_cust"), F.col("next_cust"))


def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    return edges_from_columns(customers, F.col("c_custkey") + 1000, F.col("c_nationkey") + 100).unionByName(
        edges_from_columns(nations, F.col("n_nationkey") + 100, F.col("n_regionkey"))
    )


def edge_lines(spark: SparkSession, sf_dir: str, with_bad_numbers: bool) -> DataFrame:
    """The edges of G1 as lines, in a different shape for each line number of an order."""
    by_shape = {
        1: "concat(l_partkey, ' ', l_suppkey)",
        2: "concat('  ', l_partkey, '\\t\\t', l_suppkey, ' ')",
        3: "concat('+', l_partkey, ' -', l_suppkey)",
        4: "concat('# ', l_partkey, ' ', l_suppkey)",
        5: "concat(l_partkey, ' ', l_suppkey, ' ', l_linenumber)",
        6: "concat(l_partkey, ' ', l_partkey)",
    }
    bad = "concat(l_partkey, if(l_returnflag = 'N', ' 99999999999', ' x'), l_suppkey)"
    last = bad if with_bad_numbers else by_shape[1]
    cases = " ".join(f"when {n} then {text}" for n, text in by_shape.items())
    return table(spark, sf_dir, "lineitem").select(
        F.expr(f"case l_linenumber {cases} else {last} end").alias("value")
    )

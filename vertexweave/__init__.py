"""Batch graph preparation on Spark: k-hop blocks, adjacency layouts, exports, checks.

Every operator takes DataFrames and returns DataFrames, and is built from
Spark's own expressions only, so nothing here starts a Python worker.
"""

"""Operators for preparing training text, and their queries."""

from vertexweave.llm.catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

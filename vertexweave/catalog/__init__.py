from vertexweave.catalog.oracles import oracle_sql
from vertexweave.catalog.queries import queries

__all__ = ["oracle_sql", "queries"]

"""Queries over the test tables, each with the SQL it must agree with."""

from catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

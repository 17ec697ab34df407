"""Composite audits and the registered queries with their SQL."""

from . import oracles, queries, site_queries

QUERIES = queries.QUERIES | site_queries.QUERIES
SQL = oracles.SQL | site_queries.SQL

__all__ = ["QUERIES", "SQL"]

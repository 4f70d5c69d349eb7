"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """Queries by name, and the SQL of those that SQL can express."""
    from seqloom.plans import cluster_queries, member_queries, sequence_queries

    found: dict = {}
    sql: dict = {}
    for module in (member_queries, sequence_queries, cluster_queries):
        found |= module.QUERIES
        sql |= module.ORACLE_SQL
    return found, sql

"""Queries over the given tables, with their SQL."""

from . import expression_queries, identity_queries, lookup_queries, model_queries, stream_queries, traffic_queries

MODULES = (traffic_queries, model_queries, identity_queries, lookup_queries, expression_queries, stream_queries)


def all_queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}

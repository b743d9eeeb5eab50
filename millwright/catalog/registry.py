"""All registered queries and their SQL."""

from __future__ import annotations

from millwright.catalog import answer_queries, knowledge_queries, oee_queries, operations_queries, sensor_queries, store_queries

_MODULES = (oee_queries, sensor_queries, knowledge_queries, operations_queries, store_queries, answer_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

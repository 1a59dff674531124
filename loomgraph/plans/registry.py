"""All registered queries and their SQL."""

from __future__ import annotations

from . import graph_queries, index_queries, search_queries

QUERIES: dict = {**search_queries.QUERIES, **graph_queries.QUERIES, **index_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**search_queries.ORACLE_SQL, **graph_queries.ORACLE_SQL, **index_queries.ORACLE_SQL}

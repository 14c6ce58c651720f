"""All catalogue queries by name, with their SQL where SQL can say it."""

from __future__ import annotations

from .plans import function_queries, graph_queries, read_queries, table_queries, text_queries

QUERIES = text_queries.Q | function_queries.Q | graph_queries.Q | table_queries.Q | read_queries.Q
SQL = text_queries.SQL | function_queries.SQL | graph_queries.SQL | table_queries.SQL | read_queries.SQL
flagship = text_queries.flagship

"""All queries outside the text subpackage, with their SQL twins."""

from __future__ import annotations

from seqgraph.plans import align_queries, graph_queries, io_queries, trace_queries

QUERIES = graph_queries.QUERIES | align_queries.QUERIES | io_queries.QUERIES | trace_queries.QUERIES
SQL = graph_queries.SQL | align_queries.SQL | io_queries.SQL | trace_queries.SQL

"""All queries of the library (without the training-data operators), and their SQL."""

from __future__ import annotations

from mediaflow.jobs import media_queries, packet_queries, rtcp_queries, session_queries, stream_queries

MODULES = [packet_queries, rtcp_queries, session_queries, media_queries, stream_queries]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.SQL.items()}

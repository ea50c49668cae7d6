"""All registered scene queries and their SQL."""

from __future__ import annotations

from girder.plans import geometry_queries, index_queries, model_queries, scene_queries, source_queries, stream_queries

_ALL = (scene_queries, source_queries, geometry_queries, index_queries, model_queries, stream_queries)
QUERIES: dict = {name: f for m in _ALL for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _ALL for name, sql in m.ORACLE_SQL.items()}

"""All registered queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from . import artifact_queries, board_queries, continuity_queries, file_queries, function_queries, identity_queries, matching_queries, nested_queries, ordered_queries, page_queries, store_queries, stream_queries, summary_queries

_MODULES = (summary_queries, ordered_queries, matching_queries, store_queries, function_queries, file_queries, identity_queries, stream_queries, board_queries, page_queries, artifact_queries, continuity_queries, nested_queries)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = "agg03_stage_funnel"

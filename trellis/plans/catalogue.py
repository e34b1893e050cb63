"""All registered queries of the core and their SQL twins."""

from __future__ import annotations

from trellis.plans import build_queries, graph_queries, listing_queries, problems, retrieval_queries

_MODULES = [problems, graph_queries, retrieval_queries, build_queries, listing_queries]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
FLAGSHIP = "hybrid_search"

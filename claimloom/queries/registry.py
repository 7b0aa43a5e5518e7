"""All queries of the library but those of the subpackage for training data."""

from __future__ import annotations

from claimloom.queries import analytics, core, graph_store, pipeline

MODULES = [graph_store, analytics, pipeline, core]
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in m.SQL.items()}
FLAGSHIP = analytics.search_end_to_end

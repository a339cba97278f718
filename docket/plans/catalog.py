"""The registered queries of the library and their SQL."""

from __future__ import annotations

from . import corpus, landing, logs, reports, rulings, streams

FLAGSHIP = "phrase_search_topk"
_MODULES = (corpus, logs, rulings, reports, streams, landing)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}

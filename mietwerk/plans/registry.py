"""All queries outside the llm subpackage."""

from __future__ import annotations

from mietwerk.plans import advert_queries, entity_queries, health_queries, listing_queries, model_queries, record_queries, rent_queries, state_queries, stream_queries, text_queries, work_queries

_MODULES = (listing_queries, state_queries, text_queries, model_queries, record_queries, advert_queries, work_queries, health_queries, rent_queries, stream_queries, entity_queries)
FLAGSHIP = "price_cuts"
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

"""All registered queries, by name."""

from __future__ import annotations

from functools import cache

from fareloom.plans.analytics_queries import analytics_queries
from fareloom.plans.corpus_queries import corpus_queries
from fareloom.plans.entry import Query
from fareloom.plans.ingest_queries import ingest_queries
from fareloom.plans.rank_queries import rank_queries


@cache
def catalog() -> dict[str, Query]:
    return {**corpus_queries(), **analytics_queries(), **ingest_queries(), **rank_queries()}

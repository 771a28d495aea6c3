"""Import every query module so the registry is complete, then expose it."""

from __future__ import annotations

from cellscope.plans import (  # noqa: F401
    check_queries, clean_queries, eval_queries, feature_queries, fleet_queries, holes_queries, model_queries, profile_queries, source_queries,
    split_queries,
)
from cellscope.plans.registry import REGISTRY


def spark_queries():
    return {name: q.run for name, q in REGISTRY.items()}


def oracle_queries():
    return {name: q.sql for name, q in REGISTRY.items() if q.sql is not None}

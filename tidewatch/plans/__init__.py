"""Queries over the driver tables, grouped by what they exercise."""

import importlib

MODULES = [
    "row_queries",
    "monthly_queries",
    "relation_queries",
    "detection_queries",
    "monitoring_queries",
    "quality_queries",
    "party_queries",
]


def all_queries():
    """(queries, oracles) of every module."""
    from tidewatch.plans import registry

    for m in MODULES:
        importlib.import_module(f"tidewatch.plans.{m}")
    return registry.QUERIES, registry.ORACLES

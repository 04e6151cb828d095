"""Registered queries over the supplied tables, each with its SQL twin."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("assembly_queries", "cleaning_queries", "profiling_queries", "causal_queries", "lifecycle_queries", "streaming_queries")


def load_all():
    """(queries, oracle SQL) of every family; importing a family registers it."""
    for name in FAMILIES:
        import_module(f"{__name__}.{name}")
    from .registry import ORACLE, QUERIES
    return QUERIES, ORACLE

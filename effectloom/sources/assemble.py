"""Combine several tables: strategy detection, concat, merge, separate."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame


def shared_columns(tables: list[DataFrame]) -> list[str]:
    common = set(tables[0].columns).intersection(*(t.columns for t in tables[1:]))
    return [c for c in tables[0].columns if c in common]


def id_columns(columns: list[str]) -> list[str]:
    return sorted(c for c in columns if c.endswith(("ID", "Id")))


def merge_strategy(tables: dict[str, DataFrame], min_overlap: float = 0.5) -> tuple[str, list[str]]:
    """Schema-only choice between concat, merge and separate; no data pass."""
    frames = list(tables.values())
    if len(frames) <= 1:
        return "separate", []
    common = shared_columns(frames)
    mean_width = sum(len(t.columns) for t in frames) / len(frames)
    if len(common) / max(mean_width, 1) >= min_overlap:
        return "concat", []
    keys = id_columns(common)
    return ("merge", keys) if keys else ("separate", [])


def concat_tables(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merge_tables(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Chained full outer join; clashing right-hand columns get ``_{i}``."""
    merged = tables[0]
    for i, right in enumerate(tables[1:], start=1):
        clash = {c: f"{c}_{i}" for c in right.columns if c in merged.columns and c not in keys}
        merged = merged.join(right.withColumnsRenamed(clash), on=keys, how="outer")
    return merged


def assemble(tables: dict[str, DataFrame], how: str = "auto") -> DataFrame | dict[str, DataFrame]:
    keys: list[str] = []
    if len(tables) == 1:
        return next(iter(tables.values()))
    if how == "auto":
        how, keys = merge_strategy(tables)
    frames = list(tables.values())
    if how == "concat":
        return concat_tables(frames)
    if how == "merge":
        keys = keys or id_columns(shared_columns(frames))
        if keys:
            return merge_tables(frames, keys)
    return tables


def each_table(tables: dict[str, DataFrame], step: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """Apply a cleaning step to every table on its own (separate mode)."""
    return {name: step(df) for name, df in tables.items()}

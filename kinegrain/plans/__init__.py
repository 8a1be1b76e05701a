"""The query catalogue: each query with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("motion_queries", "raster_queries", "colour_queries", "match_queries", "zoom_queries", "clip_queries")


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"kinegrain.plans.{module}"), name)
    return out


def queries() -> dict:
    """Every query by its name."""
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return _gather("SQL")

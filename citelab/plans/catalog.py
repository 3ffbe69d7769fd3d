"""Registered queries of the engine and their DuckDB twins, by area."""

from __future__ import annotations

from importlib import import_module

AREAS = ("core", "relational", "features", "statistics", "designs", "storage", "models")


def _all() -> dict:
    out: dict = {}
    for area in AREAS:
        found = import_module(f"citelab.plans.{area}").QUERIES
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"queries registered twice: {sorted(clash)}")
        out |= found
    return out


def queries() -> dict:
    return {name: fn for name, (fn, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql}

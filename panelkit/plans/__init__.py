"""Registered queries over the driver's tables."""

from __future__ import annotations

from importlib import import_module

from .registry import ENTRIES, callables, oracles

_MODULES = (
    # one module per group of the inventory
    "flagship", "scans", "projections", "joining", "aggregates", "windows", "top_k", "sets", "scalars", "calendar",
    "labels_splits", "modelling", "reporting", "whole_runs",
)


def _load() -> None:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")


def all_entries():
    _load()
    return dict(ENTRIES)


def all_queries():
    _load()
    return callables()


def all_oracles():
    _load()
    return oracles()

"""Registry of queries: name, Spark callable, oracle SQL, inventory rows covered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .standins import CTES, Tables


@dataclass(frozen=True)
class Entry:
    name: str
    rows: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, rows: str, sql: str | None = None, uses: str = ""):
    """Register a query. ``rows`` lists inventory ids, ``uses`` the oracle's named sub-selects."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        text = with_ctes(uses.split(), sql) if sql else None
        ENTRIES[name] = Entry(name, tuple(rows.split()), build, text)
        return build

    return wrap


def with_ctes(names: list[str], body: str) -> str:
    """Put the named sub-selects, and those they need, in front of ``body``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        needs, _ = CTES[name]
        for other in needs.split():
            visit(other)
        ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body.strip()
    head = ",\n".join(f"{name} AS ({CTES[name][1].strip()})" for name in ordered)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry: Entry):
        return lambda spark, sf_dir: entry.build(Tables(spark, sf_dir))

    return {name: bind(entry) for name, entry in ENTRIES.items()}


def oracles() -> dict[str, str]:
    return {name: entry.sql for name, entry in ENTRIES.items() if entry.sql}

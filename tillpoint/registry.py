"""Query registry: id -> (Spark builder over the driver's tables, DuckDB
oracle SQL or None).

whole driver tables (through ``sources.testdata``) so its work grows with
the data; none runs on made-up input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .sources import testdata as td

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    build: Builder
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if key in REGISTRY:
            raise KeyError(f"duplicate query id {key}")
        REGISTRY[key] = Entry(fn, oracle)
        return fn
    return deco


def _load_all() -> None:
    # Importing the catalog modules fills REGISTRY.
    from .plans import catalog_views  # noqa: F401
    for mod in ("catalog_aggregates", "catalog_state", "catalog_staging",
                "catalog_facts", "catalog_quality", "catalog_loyalty", "catalog_inventory",
                "catalog_loads", "catalog_sources"):
        try:
            __import__(f"{__package__}.plans.{mod}")
        except ModuleNotFoundError as e:  # not written yet
            if mod not in str(e):
                raise


def queries() -> dict[str, Builder]:
    _load_all()
    return {k: e.build for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    from .oracle_fixtures import with_fixtures
    return {k: with_fixtures(e.oracle) for k, e in REGISTRY.items() if e.oracle}


__all__ = ["register", "queries", "oracle_sql", "td"]

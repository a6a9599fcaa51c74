"""Query registry: name -> (spark builder, oracle SQL or None).

builder takes (spark, sf_dir) and returns a lazily planned DataFrame; the
oracle is DuckDB SQL over the driver's table views.  ``None`` marks an
operator the oracle cannot express (iterative or randomised beyond md5
draws); those are covered by property tests in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every plan module so that their queries register."""
    import importlib
    import pkgutil

    import tessera.plans as pkg

    for m in pkgutil.iter_modules(pkg.__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"tessera.plans.{m.name}")

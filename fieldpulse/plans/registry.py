"""Named-query registry: a Spark builder and (optionally) its DuckDB oracle SQL.

``@REGISTRY.query(name, sql)`` registers ``fn(ws: Workspace) -> DataFrame``;
``REGISTRY.callables()`` hands out ``(spark, sf_dir) -> DataFrame`` closures for
the driver contract. ``sql=None`` marks an operator the oracle cannot express
(text rendering, streaming); it then gets a rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fieldpulse.sources.adapter import Workspace


@dataclass(frozen=True)
class NamedQuery:
    name: str
    build: Callable[[Workspace], DataFrame]
    sql: str | None
    operators: tuple[str, ...]
    headline: bool


class Registry:
    def __init__(self) -> None:
        self._items: dict[str, NamedQuery] = {}

    def query(self, name: str, sql: str | None, operators: tuple[str, ...] = (),
              headline: bool = False):
        def deco(fn: Callable[[Workspace], DataFrame]):
            if name in self._items:
                raise ValueError(f"duplicate query name {name}")
            self._items[name] = NamedQuery(name, fn, sql, operators, headline)
            return fn
        return deco

    def items(self) -> dict[str, NamedQuery]:
        _load_all()
        return dict(self._items)

    def callables(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        def bind(q: NamedQuery):
            return lambda spark, sf_dir: q.build(Workspace.shared(spark, sf_dir))
        return {name: bind(q) for name, q in self.items().items()}

    def oracle(self) -> dict[str, str]:
        return {name: q.sql for name, q in self.items().items() if q.sql is not None}


REGISTRY = Registry()


def _load_all() -> None:
    # Importing the modules runs their @REGISTRY.query decorators.
    from fieldpulse.plans import (  # noqa: F401
        q_brief, q_catalogue, q_clean, q_sources, q_statements, q_text,
    )

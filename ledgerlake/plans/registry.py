"""Registry of the queries: name -> callable(spark, sf_dir), and the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: The modules whose queries are registered when they are imported.
MODULES = ("q_adjudicate", "q_intake", "q_corpus", "q_corpus_build", "q_retrieval", "q_evaluation", "q_sources", "q_judging", "q_clauses", "q_decision", "q_agent")

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable:
    """Decorator: put a query under ``name``, with its equivalent SQL where there is one."""

    def put(f: Callable) -> Callable:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"ledgerlake.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

"""Names, queries and SQL twins of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from quillspark.plans import queries_graph, queries_metrics, queries_search, queries_tables

FLAGSHIP = "hybrid_search"
_MODULES: tuple[ModuleType, ...] = (queries_search, queries_graph, queries_metrics, queries_tables)


def queries() -> dict[str, Callable]:
    """The public functions of the query modules, by name."""
    return {name: f for m in _MODULES for name, f in vars(m).items() if callable(f) and getattr(f, "__module__", "") == m.__name__ and name[0] not in "_R"}


def oracle_sql() -> dict[str, str]:
    return {name.removesuffix("_sql"): sql for m in _MODULES for name, sql in vars(m).items() if name.endswith("_sql")}

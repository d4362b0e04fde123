"""Query registry: name -> callable(spark, sf_dir), and the equivalent SQL where there is one."""

from __future__ import annotations

from importlib import import_module

PLANS = ["replay", "scoring", "calls", "windows", "text", "documents_db", "settlement", "restructure", "sources", "live"]
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under a name."""
    def put(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f
    return put


def _load() -> None:
    for p in PLANS:
        import_module(f"{__package__}.{p}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

"""Where query modules put their queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from scholion.plans.derived import with_derived

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query (spark, sf_dir) -> DataFrame with the SQL of its result, if any."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_derived(sql)
        return f

    return put

"""Registered queries of the reference's operators and the SQL that checks them."""

from __future__ import annotations

from scholion.plans import build, explore, imports, passages, registry


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)


__all__ = ["build", "explore", "imports", "oracle_sql", "passages", "queries"]

"""All queries over request traffic, by name."""

from __future__ import annotations

from . import queries_budget, queries_harvest, queries_report, queries_shapes, queries_verdicts
from .views import oracle

MODULES = [queries_report, queries_budget, queries_harvest, queries_verdicts, queries_shapes]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql) for m in MODULES for name, sql in m.SQL.items()}

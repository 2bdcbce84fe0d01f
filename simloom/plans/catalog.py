"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from simloom.plans import relational_queries, text_queries  # noqa: F401  they register themselves
from simloom.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

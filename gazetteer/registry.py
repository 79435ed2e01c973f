"""All registered queries by name, and their SQL."""

from __future__ import annotations

from .plans import suite


def queries() -> dict:
    return suite.queries()


def oracle_sql() -> dict:
    return suite.oracle_sql()

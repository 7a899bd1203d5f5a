"""Operators that prepare training data.

Nothing outside this package imports it. ``queries()`` and ``oracle_sql()``
are read by ``__spark_entry__.py`` when the package is present.
"""

from __future__ import annotations


def queries() -> dict:
    """The pN_ queries, by name."""
    from lodestrata.llm import registry

    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    """SQL for those queries that it can express."""
    from lodestrata.llm import registry

    return registry.ORACLE_SQL

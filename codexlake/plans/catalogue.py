"""All queries of the engine by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import links, pages, strings, titles

_MODULES = (titles, strings, links, pages)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The SQL of each query; that over the whole table of Chinese letters only while there is a session."""
    found = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
    return found | strings.session_sql() if SparkSession.getActiveSession() else found

"""Queries by name, each with SQL where SQL can express it."""

from __future__ import annotations

from trackframe.plans.views import with_views

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a function (spark, sf_dir) -> DataFrame; `views` names those that the SQL reads."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql, *views.split())
        return f

    return put

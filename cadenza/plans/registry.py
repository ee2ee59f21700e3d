"""A module's queries and their SQL."""

from __future__ import annotations


def registry():
    """(queries by name, SQL by name, decorator that adds a function and the SQL it is compared with)."""
    queries, sql = {}, {}

    def query(text: str | None = None):
        def add(fn):
            queries[fn.__name__] = fn
            if text:
                sql[fn.__name__] = text
            return fn

        return add

    return queries, sql, query

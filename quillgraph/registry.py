"""A place where a module puts its queries and their SQL."""

from __future__ import annotations

from quillgraph.plans import view


def registry():
    """Queries, SQL, and the decorator ``(name, sql, with_view)`` that fills both; with_view gives the SQL ``nodes`` and ``edges``."""
    queries: dict = {}
    sql_of: dict[str, str] = {}

    def query(name: str, sql: str | None = None, with_view: bool = True):
        def put(f):
            queries[name] = f
            if sql:
                text = sql.strip()
                sql_of[name] = "WITH RECURSIVE " + view.VIEW_SQL + (", " if text.startswith("q AS") else "\n") + text if with_view else text
            return f

        return put

    return queries, sql_of, query

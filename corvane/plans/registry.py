"""Names of all core queries with their SQL."""

from __future__ import annotations

from functools import wraps

from corvane.session import ship

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under `name`, with the DuckDB SQL that gives the same rows."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @wraps(f)
        def run(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return add

"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from molinete.registry.roles_sql import with_roles
from molinete.sources.roles import Roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Roles`; ``sql`` is its DuckDB twin over the same roles."""

    def register(build: Callable[[Roles], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Roles(spark, folder))
        if sql is not None:
            ORACLES[name] = with_roles(sql)
        return build

    return register

"""Where queries and the SQL that gives the same rows are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberflow.plans.views import VIEWS_SQL, Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, views: bool = True):
    """Register a function of a Model under its name, with its SQL: the body after the views' WITH, which a leading +
    goes on with; as it stands if views aren't wanted; none if empty."""

    def keep(f: Callable[[Model], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql:
            body = sql.strip()
            ORACLE_SQL[f.__name__] = (VIEWS_SQL + (", " if body.startswith("+") else "") + body.lstrip("+")) if views else body
        return f

    return keep

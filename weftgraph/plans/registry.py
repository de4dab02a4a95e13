"""Where queries are registered, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.star import star_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


def on_graph(sql: str | None = None, cyclic: bool = False):
    """Registers a function of the star graph."""

    def keep(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(star_graph(spark, sf_dir, cyclic))

        run.__name__ = function.__name__
        return query(sql)(run)

    return keep

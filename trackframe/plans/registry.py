"""Registers queries with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackframe.sources.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: str = "", more: dict[str, str] | None = None, name: str | None = None):
    """Registers a function of (views by name) as a query.

    The function gets ``v``, which gives a view's DataFrame by its name.
    ``views`` names those that ``sql`` reads; ``more`` are further expressions.
    """

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: view(spark, sf_dir, table) if table.startswith("f_") else spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__ = key
        QUERIES[key] = run
        if sql:
            ORACLES[key] = with_views(sql, *views.split(), more=more)
        return f

    return add

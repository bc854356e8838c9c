"""Catalogue of bound queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.functions.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` where ``t`` opens tables of one data folder."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from shelfmark.plans.bindings import Tables

            return fn(Tables(prepare(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap

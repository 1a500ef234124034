"""Where plans register themselves: a query by name, with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyweave.plans.fixtures import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, more: str = "", name: str | None = None) -> Callable:
    """Register a function of Views. sql may read the derived views; more are further common table expressions."""

    def register(plan: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        key = name or plan.__name__
        if key in QUERIES:
            raise ValueError(f"two queries named {key}")
        QUERIES[key] = lambda spark, sf_dir: plan(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = with_views(sql, more)
        return plan

    return register

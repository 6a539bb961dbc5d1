"""Registry of runnable queries, each with its SQL check where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logmetrics.session import prepare, ship_package

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Run], Run]:
    """Register a function ``(spark, data folder) -> DataFrame`` under its name."""

    def add(run: Run) -> Run:
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            ship_package(spark)
            return run(spark, sf_dir)

        prepared.__name__ = run.__name__
        prepared.__doc__ = run.__doc__
        QUERIES[run.__name__] = prepared
        if oracle is not None:
            ORACLES[run.__name__] = oracle
        return run

    return add

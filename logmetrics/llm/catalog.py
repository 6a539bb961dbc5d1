"""Registry of this subpackage's queries, each with its SQL check where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logmetrics.session import ship_package

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Run], Run]:
    """Register a function ``(spark, data folder) -> DataFrame`` under its name.

    Session settings stay as the caller has them.
    """

    def add(run: Run) -> Run:
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return run(spark, sf_dir)

        shipped.__name__ = run.__name__
        shipped.__doc__ = run.__doc__
        QUERIES[run.__name__] = shipped
        if oracle is not None:
            ORACLES[run.__name__] = oracle
        return run

    return add

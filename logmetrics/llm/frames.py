"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add (case ignored, as in Spark)."""
    taken = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in taken])

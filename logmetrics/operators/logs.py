"""Operators on log frames: build, select, de-duplicate, sort, combine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmetrics.functions.messages import clean_message


def build_log_frame(records: DataFrame) -> DataFrame:
    """Records to (time, message) with cleaned messages; other columns are kept."""
    others = [c for c in records.columns if c not in ("log_time", "message")]
    return records.select(
        F.col("log_time").alias("time"),
        clean_message(F.col("message")).alias("message"),
        *others,
    )


def messages(frame: DataFrame) -> DataFrame:
    return frame.select("message")


def time_range(df: DataFrame, start: str, end: str, column: str = "time") -> DataFrame:
    """Rows with start <= time <= end."""
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    return df.filter(F.col(column).between(lo, hi))


def last_per_key(df: DataFrame, key: str = "time", seq: str = "seq") -> DataFrame:
    """Per key the last non-null value of each column, in ``seq`` order.

    Last is per column, not per row. Null keys are dropped. The aggregate
    combines before the shuffle, so a hot key sends one row per task.
    """
    values = [c for c in df.columns if c not in (key, seq)]
    last = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c)
        for c in values
    ]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*last)


def sort_by_time(df: DataFrame, *tiebreak: str, column: str = "time") -> DataFrame:
    return df.orderBy(column, *tiebreak)


def append_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of two frames side by side, aligned on the row key (outer)."""
    return left.join(right, key, "full_outer")


def concat_series(*frames: DataFrame) -> DataFrame:
    """Frames stacked; duplicates stay."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame)
    return stacked


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))

"""Metric series and image tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _by_header(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with every column as text, named by the header.

    Files below one path must have the same header; one that differs is an error.
    """
    return spark.read.option("enforceSchema", False).csv(path, header=True)


def _number(column: str) -> Column:
    """A double; what is no number, and NaN, is missing."""
    return F.nanvl(F.col(f"`{column}`").try_cast("double"), F.lit(None).cast("double"))


def _need(frame: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise KeyError(f"columns missing: {missing}")


def read_series_csv(
    spark: SparkSession,
    path: str,
    *,
    value: str = "value",
    time_column: str | None = None,
    time_format: str = "yyyy-MM-dd HH:mm:ss",
) -> DataFrame:
    """(ts, value) of a header CSV; the time is the first column unless named.

    Columns are found by name in the header, in any order and among others.
    """
    frame = _by_header(spark, path)
    time_column = time_column or frame.columns[0]
    _need(frame, [time_column, value])
    stamp = F.try_to_timestamp(F.col(f"`{time_column}`"), F.lit(time_format)).cast("timestamp_ntz")
    return frame.select(stamp.alias("ts"), _number(value).alias("value"))


def read_wide_csv(
    spark: SparkSession,
    path: str,
    numeric: list[str],
    *,
    time_column: str = "Date Time",
    time_format: str = "dd.MM.yyyy HH:mm:ss",
) -> DataFrame:
    """The time column (day first) and the numeric columns of a header CSV.

    Columns are found by name in the header, in any order and among others; a
    missing one is an error, a value that is no number, and NaN, is null.
    """
    frame = _by_header(spark, path)
    _need(frame, [time_column, *numeric])
    stamp = F.to_timestamp_ntz(F.col(f"`{time_column}`"), F.lit(time_format))
    return frame.select(stamp.alias(time_column), *[_number(c).alias(c) for c in numeric])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """A table of pixel matrices with label and train/test tag."""
    schema = "id bigint, pixels array<array<int>>, label int, split string"
    return spark.read.schema(schema).parquet(path)


def profile(df: DataFrame) -> DataFrame:
    """Per column: place, type, non-null count, row count. One pass over the data."""
    fields = df.schema.fields
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.col(f"`{f.name}`")).alias(f"_c{i}") for i, f in enumerate(fields)],
    )
    entries = [
        F.struct(
            F.lit(i).cast("long").alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f"_c{i}").alias("non_null"),
            F.col("_rows").alias("rows"),
        )
        for i, f in enumerate(fields)
    ]
    return counts.select(F.inline(F.array(*entries)))

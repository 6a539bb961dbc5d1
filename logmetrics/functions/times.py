"""Column functions and small frames for times (all zone-less, read as UTC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Unit name -> microseconds.
UNIT_MICROS = {
    "microseconds": 1,
    "milliseconds": 1_000,
    "seconds": 1_000_000,
    "minutes": 60_000_000,
    "hours": 3_600_000_000,
    "days": 86_400_000_000,
    "weeks": 604_800_000_000,
}


def make_delta(unit: Column | str, count: Column | int) -> Column:
    """``count`` units as a day-time interval; null for an unknown unit."""
    name = F.lit(unit) if isinstance(unit, str) else unit
    times = F.lit(count) if isinstance(count, int) else count
    micros = F.lit(None).cast("long")
    for known, size in UNIT_MICROS.items():
        micros = F.when(name == known, F.lit(size).cast("long") * times).otherwise(micros)
    seconds = (micros.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 with the fraction, as double."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def to_datetime(seconds: Column) -> Column:
    """Epoch seconds (number or numeric string) to a timestamp."""
    micros = F.rint(seconds.cast("double") * F.lit(1e6)).cast("long")
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def to_epoch(ts: Column) -> Column:
    """Timestamp to whole epoch seconds; the fraction is dropped."""
    return F.unix_seconds(ts.cast("timestamp"))


def to_millis(seconds: Column) -> Column:
    """Milliseconds, half to even."""
    return F.rint(seconds.cast("double") * F.lit(1000.0)).cast("long")


def grid_stamps(start: Column, x: Column, *, prev: bool = False, tick: str = "hours",
                step: int = 1) -> Column:
    """``x`` stamps from ``start`` as an array of timestamps.

    Forward starts one step after ``start``; backward ends at ``start``.
    An ``x`` below one gives an empty array.
    """
    if tick not in UNIT_MICROS:
        raise ValueError(f"unknown time unit: {tick}")
    first = (F.lit(1) - x) if prev else F.lit(1)
    last = F.lit(0) if prev else x
    steps = F.when(x >= 1, F.sequence(first.cast("long"), last.cast("long"))).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.transform(steps, lambda k: start + make_delta(tick, k * F.lit(step)))


def time_grid(
    spark: SparkSession,
    x: int,
    start: str,
    *,
    prev: bool = False,
    tick: str = "hours",
    step: int = 1,
    fmt: str = "yyyy-MM-dd HH:mm:ss",
) -> DataFrame:
    """A frame of ``x`` formatted stamps before or after ``start``."""
    if tick not in UNIT_MICROS:
        raise ValueError(f"unknown time unit: {tick}")
    begin = F.to_timestamp_ntz(F.lit(start), F.lit(fmt))
    first = 1 - x if prev else 1
    places = spark.range(first, first + max(x, 0)).withColumn(
        "ts", begin + make_delta(tick, F.col("id") * step)
    )
    return places.orderBy("id").select(F.date_format("ts", fmt).alias("stamp"))

"""Overlapping row windows over long series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logmetrics.operators.features import label_positions
from logmetrics.operators.positions import row_index, shuffled_index, with_halo


def shingle(
    df: DataFrame,
    *order: str,
    value: str = "value",
    size: int = 48,
    series: Sequence[str] = (),
    chunk: int = 4096,
    indexed: bool = False,
) -> DataFrame:
    """``size`` consecutive values as one vector, on the row of the last value.

    ``order`` must start with the ``series`` columns and end unique. Chunks of
    equal length with a halo of ``size - 1`` rows bound every window task. A
    missing value is a null inside the vectors that cover it; every row from the
    ``size``-th of a series on has a vector. ``indexed`` rows have their
    position in ``order`` as ``idx`` already.
    """
    numbered = df if indexed else row_index(df, *order)
    haloed = with_halo(numbered, "idx", size=size, chunk=chunk)
    frame = (
        Window.partitionBy(*series, "_chunk").orderBy("idx").rowsBetween(-(size - 1), 0)
    )
    return (
        haloed.withColumn("_points", F.collect_list(F.struct(F.col(value).cast("double").alias("v"))).over(frame))
        .filter(~F.col("_halo") & (F.size("_points") == size))
        .withColumn("features", F.col("_points.v"))
        .drop("_chunk", "_halo", "_points")
    )


@dataclass(frozen=True)
class WindowSpec:
    """Shape of a forecasting window: inputs, then labels ``shift`` rows on."""

    columns: tuple[str, ...]
    label_columns: tuple[str, ...]
    input_width: int = 24
    label_width: int = 1
    shift: int = 1

    @property
    def total(self) -> int:
        return self.input_width + self.shift

    @property
    def batch_size(self) -> int:
        return int(self.input_width / 2)

    def describe(self, spark: SparkSession) -> DataFrame:
        """One row: total size, input places, label places, label names."""
        start = self.total - self.label_width
        return spark.range(1).select(
            F.lit(self.total).cast("long").alias("total_window_size"),
            F.sequence(F.lit(0), F.lit(self.input_width - 1)).alias("input_indices"),
            F.sequence(F.lit(start), F.lit(self.total - 1)).alias("label_indices"),
            F.array(*[F.lit(c) for c in self.label_columns]).alias("label_columns"),
        )


def sliding_windows(
    df: DataFrame, spec: WindowSpec, *, idx: str = "idx", split: str = "split", chunk: int = 4096
) -> DataFrame:
    """Windows of ``spec.total`` rows, one per start row, never across splits.

    Gives (split, idx of the first row, window as an array of feature rows in
    float32 as the reference trains on).
    """
    features = F.array(*[F.col(f"`{c}`").cast("float") for c in spec.columns])
    rows = df.select(split, idx, features.alias("_row"))
    haloed = with_halo(rows, idx, size=spec.total, chunk=chunk, following=True)
    frame = (
        Window.partitionBy(split, "_chunk").orderBy(idx).rowsBetween(0, spec.total - 1)
    )
    return (
        haloed.withColumn("window", F.collect_list("_row").over(frame))
        .filter(~F.col("_halo") & (F.size("window") == spec.total))
        .select(split, idx, "window")
    )


def window_slices(windows: DataFrame, spec: WindowSpec) -> DataFrame:
    """inputs = first rows with all columns; labels = last rows, label columns only."""
    places = label_positions(spec.columns, spec.label_columns)

    def only_labels(row: Column) -> Column:
        return F.array(*[row[k] for k in places])

    labels = F.slice("window", -spec.label_width, spec.label_width)
    return windows.withColumns(
        {
            "inputs": F.slice("window", 1, spec.input_width),
            "labels": F.transform(labels, only_labels),
        }
    ).drop("window")


def split_dataset(windows: DataFrame, part: str, split: str = "split") -> DataFrame:
    return windows.filter(F.col(split) == part)


def shuffle_batches(
    df: DataFrame, key: str, *, batch_size: int, seed: int = 0, n: int | None = None
) -> DataFrame:
    """A repeatable random order cut into batches; the last may be short."""
    total = df.count() if n is None else n
    placed = shuffled_index(df, key, seed=seed, n=total)
    return placed.withColumn("batch", F.expr(f"pos div {batch_size}")).drop("round")


def example_batch(batches: DataFrame) -> DataFrame:
    """The first batch, kept for reuse."""
    return batches.filter(F.col("batch") == 0).persist()

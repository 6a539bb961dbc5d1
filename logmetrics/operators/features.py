"""Feature columns: sentinels, wind vectors, calendar cycles, scaling, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmetrics.functions.times import epoch_seconds

# Fixed values of the weather preparation.
SENTINEL = -9999.0
DAY_SECONDS = 24 * 60 * 60
YEAR_SECONDS = 365.2425 * DAY_SECONDS


def replace_sentinel(
    df: DataFrame, columns: Sequence[str], *, sentinel: float = SENTINEL, value: float = 0.0
) -> DataFrame:
    """The marker for "no measurement" becomes ``value``."""
    fixed = {
        c: F.when(F.col(f"`{c}`") == sentinel, F.lit(value)).otherwise(F.col(f"`{c}`"))
        for c in columns
    }
    return df.withColumns(fixed)


def polar_to_xy(df: DataFrame, speeds: dict[str, str], direction: str) -> DataFrame:
    """Speed and direction in degrees to x and y parts; the sources are dropped.

    ``speeds`` maps a speed column to the stem of its results:
    ``{"wv (m/s)": "W"}`` gives ``Wx`` and ``Wy``.
    """
    angle = F.col(f"`{direction}`") * F.pi() / F.lit(180)
    parts: dict[str, Column] = {}
    for speed, stem in speeds.items():
        parts[f"{stem}x"] = F.col(f"`{speed}`") * F.cos(angle)
        parts[f"{stem}y"] = F.col(f"`{speed}`") * F.sin(angle)
    return df.withColumns(parts).drop(*speeds, direction)


def cyclic_time(df: DataFrame, ts: str) -> DataFrame:
    """Sine and cosine of the place in the day and in the year."""
    seconds = epoch_seconds(F.col(f"`{ts}`"))
    day = seconds * (F.lit(2.0) * F.pi() / F.lit(float(DAY_SECONDS)))
    year = seconds * (F.lit(2.0) * F.pi() / F.lit(YEAR_SECONDS))
    return df.withColumns(
        {
            "Day sin": F.sin(day),
            "Day cos": F.cos(day),
            "Year sin": F.sin(year),
            "Year cos": F.cos(year),
        }
    )


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def scale_constant(values: Column, divisor: float) -> Column:
    return values / F.lit(float(divisor))


def flatten_matrix(matrix: Column) -> Column:
    return F.flatten(matrix)


def scale_pixels(matrix: Column, divisor: float = 255.0) -> Column:
    """A pixel matrix as one row-order vector, each value divided."""
    return F.transform(flatten_matrix(matrix), lambda x: x.cast("double") / F.lit(divisor))


def cast_numeric(df: DataFrame, columns: Sequence[str], to: str = "double") -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`").cast(to) for c in columns})


def as_vector(*columns: str) -> Column:
    """Columns as one feature array, in the order given."""
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])


def column_positions(columns: Sequence[str]) -> dict[str, int]:
    return {name: i for i, name in enumerate(columns)}


def label_positions(columns: Sequence[str], labels: Sequence[str]) -> list[int]:
    """Places of the label columns among the feature columns."""
    places = column_positions(columns)
    return [places[name] for name in labels]


def minmax_normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min) per column; a constant column gives null.

    The bounds are scalar subqueries: one pass with map-side partials, and no
    join.
    """
    bounds = df.agg(
        F.struct(
            *[F.min(f"`{c}`").alias(f"lo{i}") for i, c in enumerate(columns)],
            *[F.max(f"`{c}`").alias(f"hi{i}") for i, c in enumerate(columns)],
        ).alias("b")
    ).scalar()
    scaled = {}
    for i, c in enumerate(columns):
        span = F.nullif(bounds[f"hi{i}"] - bounds[f"lo{i}"], F.lit(0.0))
        scaled[c] = (F.col(f"`{c}`") - bounds[f"lo{i}"]) / span
    return df.withColumns(scaled)


def fit_zscore(df: DataFrame, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """One row of mean and sample deviation per column, from the ``where`` part only."""
    part = df if where is None else df.filter(where)
    return part.agg(
        *[F.avg(f"`{c}`").alias(f"mean_{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(f"`{c}`").alias(f"std_{i}") for i, c in enumerate(columns)],
    )


def apply_zscore(
    df: DataFrame, stats: DataFrame, columns: Sequence[str], *, inverse: bool = False
) -> DataFrame:
    """(x - mean) / std with the fitted row, or back with ``inverse``."""
    fitted = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    out = {}
    for i, c in enumerate(columns):
        mean, std = fitted[f"mean_{i}"], fitted[f"std_{i}"]
        x = F.col(f"`{c}`")
        out[c] = x * std + mean if inverse else (x - mean) / std
    return df.withColumns(out)


def contamination(df: DataFrame, flag: str = "event") -> DataFrame:
    """Share of flagged rows."""
    return df.agg(
        (F.sum(F.col(flag).cast("double")) / F.count(F.lit(1))).alias("contamination")
    )


def vector_sum(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def axis_bounds(df: DataFrame, columns: Sequence[str], shift: float) -> DataFrame:
    """One row: min - shift and max + shift over all the given columns."""
    lows = [F.min(f"`{c}`") for c in columns]
    highs = [F.max(f"`{c}`") for c in columns]
    low = lows[0] if len(lows) == 1 else F.least(*lows)
    high = highs[0] if len(highs) == 1 else F.greatest(*highs)
    return df.agg((low - F.lit(shift)).alias("low"), (high + F.lit(shift)).alias("high"))

"""The row at a position of an order, found by counting instead of sorting.

Each order column becomes a key of hex digits that sorts like the column. A pass
counts the rows per next four digits of the key, so at most 16**4 numbers reach
the driver; the digits that hold the position are kept and the rest is left
aside. Bounds taken before each pass skip the digits all remaining rows share.
When few rows remain, those alone are sorted. Nothing is written and no row
moves but the last few; a pass reads the table again, so ``df`` should be stored.
"""

from __future__ import annotations

import os
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hex digits counted in one pass.
DIGITS = 4
#: So few remaining rows are sorted.
FEW = 10_000


@F.pandas_udf(T.LongType())
def _double_bits(values: pd.Series) -> pd.Series:
    """Bits of doubles as integers of the same order; -0.0 is 0.0, not-a-numbers are alike and last."""
    x = values.to_numpy(np.float64, na_value=np.nan) + 0.0
    x[np.isnan(x)] = np.nan
    bits = np.abs(x).view(np.int64)
    return pd.Series(np.where(x < 0, -bits, bits))


def sort_key(df: DataFrame, name: str) -> Column:
    """Text of hex digits in the order of a column; null, as in an ascending sort, is first."""
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.StringType, T.TimestampNTZType)):
        digits = F.hex(column.cast("string"))  # zone-less times of years 0 to 9999 sort as their text
    elif isinstance(kind, T.BinaryType):
        digits = F.hex(column)
    else:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            number = _double_bits(column.cast("double"))
        elif isinstance(kind, T.DateType):
            number = F.unix_date(column).cast("bigint")
        elif isinstance(kind, T.TimestampType):
            number = F.unix_micros(column)
        elif isinstance(kind, (T.IntegralType, T.BooleanType)):
            number = column.cast("bigint")
        else:
            raise TypeError(f"column {name}: no sort key for {kind.simpleString()}")
        digits = F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.when(column.isNull(), "0").otherwise(F.concat(F.lit("1"), digits))


def _narrow(part: DataFrame, key: Column, place: int) -> tuple[DataFrame, int, int]:
    """(rows around the place, the place among them, how many): all of one key, or few."""
    while True:
        low, high, n = part.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        if n <= FEW or low == high or place >= n:
            return part, place, n
        stem = os.path.commonprefix([low, high])
        digits = F.substring(key, len(stem) + 1, DIGITS)
        counts = part.groupBy(digits.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
        for digit, held in sorted((r["d"], r["n"]) for r in counts):
            if place < held:
                break
            place -= held
        part = part.where(digits == digit)


def _around(df: DataFrame, position: int, order: tuple[str, ...]) -> tuple[DataFrame, int] | None:
    """Few rows, or rows alike in all order columns, with the position among them; None beyond the table."""
    if not order:
        raise ValueError("an order needs columns")
    part, place, n = df, position, 0
    for name in order:
        part, place, n = _narrow(part, sort_key(df, name), place)
        if not 0 <= place < n:
            return None
        if n <= FEW:
            break
    return part, place if n <= FEW else 0


def row_at(df: DataFrame, position: int, *order: str) -> DataFrame:
    """The row at a zero-based position of an ascending order, nulls first; none beyond the table.

    Of rows alike in all of ``order`` it is any one.
    """
    found = _around(df, position, order) if position >= 0 else None
    if found is None:
        return df.limit(0)
    part, place = found
    return part.orderBy(*order).offset(place).limit(1) if place else part.orderBy(*order).limit(1)


def key_at(df: DataFrame, position: int, *order: str) -> tuple | None:
    """Values of the order columns of the row at a position; None beyond the table."""
    row = row_at(df.select(*[F.col(f"`{c}`") for c in order]), position, *order).first()
    return None if row is None else tuple(row)


def not_after(key: tuple, *order: str) -> Column:
    """Rows that stand, in the ascending order, at or before a key of :func:`key_at`."""
    columns = [F.col(f"`{c}`") for c in order]
    limits = [F.lit(v) for v in key]
    last = reduce(lambda a, b: a & b, [c.eqNullSafe(v) for c, v in zip(columns, limits, strict=True)])
    same, before = F.lit(True), last
    for c, v, value in zip(columns, limits, key, strict=True):
        lower = F.lit(False) if value is None else c.isNull() | F.coalesce(c < v, F.lit(False))
        before = before | (same & lower)
        same = same & c.eqNullSafe(v)
    return before

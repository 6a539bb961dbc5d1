import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logmetrics.operators import features as f


def column(df, name):
    return [r[name] for r in df.orderBy("k").collect()]


def test_replace_sentinel(spark):
    df = spark.createDataFrame([(0, -9999.0, 1.0), (1, 2.0, -9999.0)], "k int, `wv (m/s)` double, b double")
    out = f.replace_sentinel(df, ["wv (m/s)"])
    assert column(out, "wv (m/s)") == [0.0, 2.0] and column(out, "b") == [1.0, -9999.0]


def test_polar_to_xy(spark):
    df = spark.createDataFrame([(k, 2.0, float(d)) for k, d in enumerate((0, 90, 180, 360))],
                               "k int, v double, deg double")
    out = f.polar_to_xy(df, {"v": "W"}, "deg")
    assert set(out.columns) == {"k", "Wx", "Wy"}
    assert column(out, "Wx") == pytest.approx([2, 0, -2, 2], abs=1e-12)
    assert column(out, "Wy") == pytest.approx([0, 2, 0, 0], abs=1e-12)


def test_cyclic_time(spark):
    df = spark.createDataFrame([(0, datetime(1970, 1, 1)), (1, datetime(1970, 1, 1, 6))],
                               "k int, ts timestamp_ntz")
    out = f.cyclic_time(df, "ts")
    assert column(out, "Day sin") == pytest.approx([0, 1])
    assert column(out, "Day cos") == pytest.approx([1, 0], abs=1e-12)
    assert column(out, "Year sin")[1] == pytest.approx(math.sin(2 * math.pi * 0.25 / 365.2425))


def test_pixels(spark):
    df = spark.createDataFrame([([[0, 255], [51, 102]],)], "p array<array<int>>")
    assert df.select(f.scale_pixels(F.col("p")).alias("v")).first()["v"] == [0.0, 1.0, 0.2, 0.4]


def test_minmax_with_constant_column(spark):
    df = spark.createDataFrame([(0, 2.0, 5.0), (1, 4.0, 5.0), (2, 3.0, 5.0)], "k int, x double, c double")
    out = f.minmax_normalize(df, ["x", "c"])
    assert column(out, "x") == [0.0, 1.0, 0.5] and column(out, "c") == [None] * 3


def test_zscore_uses_the_train_part_and_inverts(spark):
    df = spark.createDataFrame([(0, 1.0, "train"), (1, 3.0, "train"), (2, 9.0, "test")],
                               "k int, x double, split string")
    stats = f.fit_zscore(df, ["x"], F.col("split") == "train")
    assert tuple(stats.first()) == pytest.approx((2.0, math.sqrt(2)))
    out = f.apply_zscore(df, stats, ["x"])
    assert column(out, "x")[2] == pytest.approx(7 / math.sqrt(2))
    assert column(f.apply_zscore(out, stats, ["x"], inverse=True), "x") == pytest.approx([1, 3, 9])


def test_small_aggregates(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (1, 0, 6.0), (2, 0, 4.0), (3, 0, 4.0)],
                               "k int, event int, x double")
    assert f.contamination(df).first()[0] == 0.25
    low, high = f.axis_bounds(df, ["x"], 0.15).first()
    assert (low, high) == pytest.approx((1.85, 6.15))
    vector = df.select(f.vector_sum(F.array("x", "x")).alias("s")).first()["s"]
    assert vector == 4.0


def test_label_positions():
    assert f.label_positions(["a", "b", "c"], ["c", "a"]) == [2, 0]

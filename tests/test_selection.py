import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from logmetrics.operators import iforest, selection
from logmetrics.operators import positions as pos
from logmetrics.operators.selection import key_at, not_after, row_at, sort_key


@pytest.fixture(autouse=True)
def few(monkeypatch):
    """So few rows that every pass is taken."""
    monkeypatch.setattr(selection, "FEW", 4)


@pytest.fixture(scope="module")
def mixed(spark):
    """Ties on every column, nulls, negative numbers, long shared beginnings."""
    draw = np.random.default_rng(2)
    doubles = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 5e-324, -1.5, 1e300]
    rows = []
    for k in range(600):
        x = doubles[k % 9] if k % 3 else float(draw.normal())
        s = None if k % 50 == 0 else "https://host/" + "é" * (k % 4) + str(int(draw.integers(0, 30)))
        n = None if k % 70 == 0 else int(draw.integers(-(2**62), 2**62)) if k % 2 else k % 5
        at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(draw.integers(0, 50)), microseconds=k % 3 * 500000)
        rows.append((k, x, s, n, at, dt.date(1960 + k % 90, 1, 1), k % 2 == 0))
    names = "id long, x double, s string, n long, at timestamp_ntz, d date, b boolean"
    return spark.createDataFrame(rows, names).repartition(5)


def test_keys_sort_like_their_columns(mixed):
    for name in ("x", "s", "n", "at", "d", "b"):
        ranks = mixed.select("id", name, sort_key(mixed, name).alias("k")).orderBy(name, "id").collect()
        keys = [r["k"] for r in ranks]
        assert keys == sorted(keys), name


@pytest.mark.parametrize("order", [("x", "id"), ("s", "n", "id"), ("at", "b", "id")])
def test_row_at_is_the_sorted_row(mixed, order):
    want = [r["id"] for r in mixed.orderBy(*order).collect()]
    for position in (1, 300, 599):
        assert row_at(mixed, position, *order).first()["id"] == want[position], (order, position)
    assert row_at(mixed, 600, *order).count() == row_at(mixed, -1, *order).count() == 0


def test_rows_up_to_a_key(mixed):
    rows = mixed.where("not isnan(x)")
    order = ("s", "n", "id")
    want = [r["id"] for r in rows.orderBy(*order).collect()]
    for position in (5, len(want) - 1):
        key = key_at(rows, position, *order)
        kept = {r["id"] for r in rows.where(not_after(key, *order)).collect()}
        assert kept == set(want[: position + 1])
    assert key_at(rows, 10_000, *order) is None
    assert key_at(rows.limit(0), 0, *order) is None


def test_rows_that_are_all_alike(spark):
    same = spark.range(50).select(F.lit(3).alias("a"), F.lit("x").alias("s"))
    assert row_at(same, 49, "a", "s").first()["a"] == 3
    assert row_at(same, 50, "a", "s").count() == 0
    with pytest.raises(ValueError):
        row_at(same, 0)
    with pytest.raises(TypeError):
        row_at(same.select(F.array("a").alias("a")), 0, "a")


def test_nothing_is_written(spark, mixed, monkeypatch):
    def no(*_, **__):
        raise AssertionError("wrote a table")

    monkeypatch.setattr(pos, "materialize", no)
    assert pos.take_record(mixed, "x", "id", index=600).count() == 1
    tail = pos.tail_numbered(mixed, "at", "id", n=4).orderBy("line_no").collect()
    want = mixed.orderBy("at", "id").collect()[-4:]
    assert [(r["id"], r["line_no"]) for r in tail] == [(r["id"], 597 + k) for k, r in enumerate(want)]


def test_threshold_is_the_interpolated_quantile(spark):
    values = np.random.default_rng(7).normal(size=501).round(1)
    scores = spark.createDataFrame([(float(v),) for v in values], "score double")
    for share in (0.05, 0.1, 0.013, 0.0, 1.0):
        got = iforest.iforest_threshold(scores, share).first()["threshold"]
        assert got == pytest.approx(np.quantile(values, 1 - share))
    assert iforest.iforest_threshold(scores.limit(0), 0.1).first()["threshold"] is None

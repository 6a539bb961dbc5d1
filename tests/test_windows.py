import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logmetrics.operators import windows as w
from logmetrics.operators.positions import chrono_split

START = datetime(2014, 7, 1)


def frame(spark, n, name="a"):
    rows = [(name, START + timedelta(minutes=30 * k), float(k)) for k in range(n)]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, value double")


@pytest.mark.parametrize(("n", "points"), [(3, 0), (4, 1), (50, 47)])
def test_shingle_counts(spark, n, points):
    got = w.shingle(frame(spark, n), "ts", size=4).orderBy("ts").collect()
    assert len(got) == points
    for k, r in enumerate(got):
        assert r["features"] == [float(k + j) for j in range(4)]
        assert r["ts"] == START + timedelta(minutes=30 * (k + 3))


def test_shingle_does_not_depend_on_the_chunk(spark):
    rows = frame(spark, 200).unionByName(frame(spark, 77, "b")).unionByName(frame(spark, 3, "c"))

    def points(chunk):
        out = w.shingle(rows, "series", "ts", series=["series"], size=8, chunk=chunk)
        return sorted((r["series"], r["ts"], tuple(r["features"])) for r in out.collect())

    assert points(7) == points(50) == points(4096)
    assert len(points(7)) == 193 + 70


SPEC = w.WindowSpec(columns=("value", "twice"), label_columns=("twice",), input_width=4)


def test_shingle_keeps_missing_values(spark):
    """A null value leaves a hole in the vectors over it and removes none."""
    rows = frame(spark, 12).withColumn("value", F.when(F.col("value") != 5, F.col("value")))
    got = [r["features"] for r in w.shingle(rows, "ts", size=3).orderBy("ts").collect()]
    assert len(got) == 10 and sum(None in v for v in got) == 3


def split_rows(spark, n=100):
    return chrono_split(
        frame(spark, n).withColumn("twice", F.col("value") * 2).drop("series"), "ts"
    )


def test_windows_stay_inside_their_split(spark):
    got = w.sliding_windows(split_rows(spark), SPEC, chunk=6)
    counts = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert counts == {"train": 70 - 4, "validation": 20 - 4, "test": 10 - 4}
    wide = w.sliding_windows(split_rows(spark), SPEC)
    assert sorted(map(str, got.collect())) == sorted(map(str, wide.collect()))


def test_window_slices(spark):
    first = w.window_slices(w.sliding_windows(split_rows(spark), SPEC), SPEC).orderBy("idx").first()
    assert first["inputs"] == [[float(k), 2.0 * k] for k in range(4)]
    assert first["labels"] == [[8.0]]


def test_window_spec(spark):
    row = w.WindowSpec(("a",), ("T (degC)",)).describe(spark).first()
    assert row["total_window_size"] == 25
    assert row["input_indices"] == list(range(24)) and row["label_indices"] == [24]
    assert row["label_columns"] == ["T (degC)"]


def test_batches(spark):
    placed = w.shuffle_batches(spark.range(25).repartition(3), "id", batch_size=12, seed=4).collect()
    order = sorted(range(25), key=lambda i: hashlib.md5(f"4:0:{i}".encode()).hexdigest())
    assert {r["id"]: r["batch"] for r in placed} == {i: p // 12 for p, i in enumerate(order)}
    assert w.WindowSpec(("a",), ("a",)).batch_size == 12


def test_example_batch(spark):
    batches = w.shuffle_batches(spark.range(25), "id", batch_size=12)
    first = w.example_batch(batches)
    assert first.count() == 12 and first.is_cached
    first.unpersist()

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from logmetrics.operators.intervals import Interval
from logmetrics.plans import jobs

BASE = datetime(2021, 9, 15)


def test_log_job_finds_the_injected_faults(spark):
    rows = [(BASE + timedelta(seconds=k), f"sshd[{k}]: session opened", k) for k in range(600)]
    logs = spark.createDataFrame(rows, "log_time timestamp_ntz, message string, seq long")
    words = [("sshd", [1.0, 0.0, 0.0]), ("session", [0.0, 1.0, 0.0]), ("opened", [0.5, 0.5, 0.0]),
             ("error", [0.0, 0.0, 4.0])]
    vectors = spark.createDataFrame(words, "token string, vector array<double>")
    faults = [Interval("error", BASE + timedelta(seconds=330), BASE + timedelta(seconds=335))]
    out = jobs.log_anomalies(logs, vectors, faults=faults, num_trees=10, tree_size=256)
    means = {r["event"]: r["s"] for r in out.groupBy("event").agg(F.avg("rcf").alias("s")).collect()}
    assert out.count() == 600 and means[1] > 0.5 and means[0] < 0.05


def test_series_job_scores_rise_in_the_event(spark):
    values = np.sin(np.arange(1000) / 10) * 10
    values[500:520] += 80
    rows = [("a", BASE + timedelta(minutes=30 * k), float(v)) for k, v in enumerate(values)]
    series = spark.createDataFrame(rows, "series string, ts timestamp_ntz, value double")
    event = [Interval("spike", rows[500][1], rows[519][1])]
    out = jobs.series_comparison(
        series, event, group=["series"], size=8, num_trees=20, tree_size=128
    )
    means = out.groupBy("event").agg(F.avg("rcf").alias("rcf"), F.avg("iforest").alias("ifo")).collect()
    by = {r["event"]: r for r in means}
    assert out.count() == 1000 and out.filter("rcf is null and iforest is null").count() == 7
    assert by[1]["rcf"] > 2 * by[0]["rcf"] and by[1]["ifo"] > by[0]["ifo"]


def test_weather_job_shapes(spark):
    rows = [(k, BASE + timedelta(minutes=10 * k), -9999.0 if k % 9 == 0 else 2.0 + k % 5, 3.0 + k % 4,
             float(k * 30 % 360), float(k % 24)) for k in range(1200)]
    frame = spark.createDataFrame(
        rows, "k long, `Date Time` timestamp_ntz, `wv (m/s)` double, `max. wv (m/s)` double, "
        "`wd (deg)` double, `T (degC)` double"
    )
    windows, spec = jobs.weather_windows(frame, "Date Time", "k")
    assert set(spec.columns) == {"T (degC)", "Wx", "Wy", "max Wx", "max Wy", "Day sin", "Day cos",
                                 "Year sin", "Year cos"}
    counts = {r["split"]: r["count"] for r in windows.groupBy("split").count().collect()}
    assert counts == {"train": 140 - 24, "validation": 40 - 24}  # 20 test rows hold no window
    first = windows.first()
    assert len(first["inputs"]) == 24 and len(first["inputs"][0]) == 9 and len(first["labels"][0]) == 1

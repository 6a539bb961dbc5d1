import datetime as dt

import pytest

from logmetrics.sources import logstore
from logmetrics.sources.logs import search_logs

SPANS = [
    ("2024-01-02 00:00:00", "2024-01-02 23:59:59", "7", None),
    ("2024-01-01 12:00:00", "2024-01-09 12:00:00", None, "disk 33 é"),
    ("2024-01-01 00:00:00", "2024-01-09 00:00:00", "auth", "disk 33 é"),
    ("2024-01-01 00:00:00", "2024-01-09 00:00:00", None, "no such text"),
    ("2024-01-05 00:00:00", "2024-01-05 00:00:00", None, None),
    ("2024-01-01 00:00:00", "2024-01-09 00:00:00", None, "k 3"),
    ("2024-01-01 00:00:00", "2024-01-09 00:00:00", None, "é"),
]


@pytest.fixture(scope="module")
def logs(spark):
    rows = []
    for k in range(900):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=13 * k)
        message = None if k % 90 == 0 else f"disk {k % 40} é" if k % 7 else "ok"
        rows.append((None if k == 5 else at, ("auth", "7", None)[k % 3], message, k))
    return spark.createDataFrame(rows, "log_time timestamp_ntz, log_type string, message string, seq long")


@pytest.fixture(scope="module")
def store(spark, logs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "landed")
    logstore.land_logs(logs.where("seq < 500"), path)
    logstore.land_logs(logs.where("seq >= 500"), path)
    return path


@pytest.mark.parametrize("start,end,kind,text", SPANS)
def test_rows_are_the_plain_searchs(spark, logs, store, start, end, kind, text):
    want = search_logs(logs, start, end, log_type=kind, message=text)
    got = logstore.search_store(spark, store, start, end, log_type=kind, message=text)
    assert sorted(got.columns) == sorted(want.columns)
    key = ["seq", "log_type", "message", "log_time"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def scanned(df):
    """Files that a plan really opens, by the names its rows come from and the scan's own count."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numFiles").value() for k in range(leaves.size()))


def test_fewer_files_are_read(spark, store):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        every = scanned(spark.read.parquet(f"{store}/logs"))
        day = logstore.search_store(spark, store, "2024-01-02 00:00:00", "2024-01-02 23:00:00", log_type="auth")
        text = logstore.search_store(spark, store, "2024-01-01 00:00:00", "2024-01-09 00:00:00", message="k 33 ")
        assert 0 < scanned(day) <= every / 8
        assert 0 < scanned(text) < every
        assert logstore.search_store(spark, store, *SPANS[3][:2], message="no such text").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_files_without_an_entry_are_read(spark, logs, store, tmp_path):
    path = str(tmp_path / "s")
    logstore.land_logs(logs.where("seq < 100"), path)
    late = logs.where("seq >= 100").selectExpr("*", "to_date(log_time) AS date")
    late.write.mode("append").partitionBy("date", "log_type").parquet(f"{path}/logs")
    span = ("2024-01-01 00:00:00", "2024-02-01 00:00:00")
    want = search_logs(logs, *span, message="disk 33").count()
    assert logstore.search_store(spark, path, *span, message="disk 33").count() == want
    logstore.land_logs(logs.limit(0), path)  # takes up the files
    table = spark.read.parquet(f"{path}/triples")
    files = {r[0].split("/")[-1] for r in spark.read.parquet(f"{path}/logs").selectExpr("input_file_name()").distinct().collect()}
    assert {r["file"].split("/")[-1] for r in table.collect()} == files
    assert logstore.search_store(spark, path, *span, message="disk 33").count() == want
    with pytest.raises(FileNotFoundError):
        logstore.search_store(spark, str(tmp_path / "none"), *span)

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logmetrics.operators import logs as lg
from logmetrics.sources import lines, logs, series

T1, T2 = datetime(2021, 9, 15, 0, 0, 1), datetime(2021, 9, 15, 0, 0, 2)


def envelope(count, records, valid=True):
    return {
        "searchTime": "1", "logCount": count, "is_VALID": valid, "invalid_MSG": "",
        "log_type": "system", "logCmpList": records,
    }


@pytest.fixture()
def landed(tmp_path):
    record = {"log_time": "2021-09-15 00:00:01", "message": "sshd[1]: opened"}
    bodies = [envelope(2, [record, record]), envelope(3, [record]), envelope(0, [], False)]
    for k, body in enumerate(bodies):
        (tmp_path / f"r{k}.json").write_text(json.dumps(body, indent=2))
    return str(tmp_path)


def test_envelope_rows_follow_the_list(spark, landed):
    rows = logs.read_log_envelopes(spark, landed).collect()
    assert len(rows) == 3
    assert rows[0]["log_time"] == T1 and rows[0]["log_type"] == "system"


def test_envelope_header_checks_the_count(spark, landed):
    header = logs.envelope_header(logs.read_envelopes(spark, landed)).collect()
    assert {(r["logCount"], r["valid"]) for r in header} == {(2, True), (3, False), (0, True)}


def test_envelope_header_missing_key(spark):
    with pytest.raises(KeyError):
        logs.envelope_header(spark.range(1).withColumn("logCmpList", F.array()))


def test_search_logs_is_closed_and_contains(spark):
    rows = spark.createDataFrame(
        [(T1, "a", "x [1]"), (T2, "a", "y"), (T2, "b", "x [1]"), (T1, "a", None)],
        "log_time timestamp_ntz, log_type string, message string",
    )
    both = logs.search_logs(rows, str(T1), str(T2), log_type="a")
    assert both.count() == 3
    assert logs.search_logs(rows, str(T1), str(T1), log_type="a", message="[1]").count() == 1
    assert logs.search_logs(rows, str(T2), str(T1)).count() == 0


def test_json_parse_keeps_raw_text(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("",), (None,)], "body string")
    got = logs.json_parse(df, "body", "k int").collect()
    assert [(r["parsed"].k if r["parsed"] else None, r["raw"]) for r in got] == [
        (1, None), (None, ""), (None, None),
    ]
    broken = ["plain text", '{"k": ', '{"k": "no number"}', "[1", '{"k": 2, "more": 1}']
    df = spark.createDataFrame([(b,) for b in broken], "body string")
    got = {r["body"]: (r["parsed"].k if r["parsed"] else None, r["raw"]) for r in logs.json_parse(df, "body", "k int").collect()}
    assert got == {b: (None, b) for b in broken[:4]} | {broken[4]: (2, None)}


def test_json_text_uses_string_forms(spark):
    df = spark.createDataFrame([(T1, [1, 2])], "at timestamp_ntz, xs array<int>")
    text = logs.to_json_text(df).first()["json"]
    assert json.loads(text) == {"at": str(T1), "xs": [1, 2]}
    nulls = spark.createDataFrame([(1, None)], "a int, b string")
    assert logs.to_json_text(nulls).first()["json"] == '{"a":1,"b":null}'


def test_build_log_frame(spark):
    rows = spark.createDataFrame([(T1, "a[1]: b", 0)], "log_time timestamp_ntz, message string, seq long")
    assert lg.build_log_frame(rows).collect() == [(T1, "a b", 0)]
    assert lg.build_log_frame(rows.limit(0)).count() == 0


def test_last_per_key_is_per_column_and_non_null(spark):
    rows = spark.createDataFrame(
        [(T1, "a", None, 1), (T1, None, "z", 2), (T2, "b", "x", 3), (T2, "c", None, 4),
         (None, "d", "d", 5)],
        "time timestamp_ntz, message string, kind string, seq long",
    )
    got = {r["time"]: (r["message"], r["kind"]) for r in lg.last_per_key(rows).collect()}
    assert got == {T1: ("a", "z"), T2: ("c", "x")}


def test_time_range_is_closed(spark):
    rows = spark.createDataFrame([(T1,), (T2,)], "time timestamp_ntz")
    assert lg.time_range(rows, str(T1), str(T2)).count() == 2
    assert lg.time_range(rows, str(T1), str(T1)).count() == 1


def test_append_and_concat(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(2, 20), (3, 30)], "k int, b int")
    got = {tuple(r) for r in lg.append_columns(a, b, "k").collect()}
    assert got == {(1, "x", None), (2, "y", 20), (3, None, 30)}
    assert lg.concat_series(a, a).count() == 4


def test_series_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("timestamp,value\n2014-07-01 00:00:00,10844\n2014-07-01 00:30:00,\n")
    rows = series.read_series_csv(spark, str(tmp_path / "s.csv")).collect()
    assert [(r["ts"], r["value"]) for r in rows] == [
        (datetime(2014, 7, 1), 10844.0), (datetime(2014, 7, 1, 0, 30), None),
    ]


def test_wide_csv_is_day_first(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Date Time,wv (m/s),T (degC)\n02.01.2009 00:10:00,1.5,-8.0\n")
    row = series.read_wide_csv(spark, str(tmp_path / "w.csv"), ["wv (m/s)", "T (degC)"]).first()
    assert tuple(row) == (datetime(2009, 1, 2, 0, 10), 1.5, -8.0)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    """Other columns, another order, NaN and blanks."""
    text = "Date Time,p (mbar),T (degC),wv (m/s)\n02.01.2009 00:10:00,996.5,-8.0,1.5\n03.01.2009 00:00:00,1,NaN,\n"
    (tmp_path / "w.csv").write_text(text)
    rows = series.read_wide_csv(spark, str(tmp_path / "w.csv"), ["wv (m/s)", "T (degC)"]).collect()
    assert [tuple(r)[1:] for r in rows] == [(1.5, -8.0), (None, None)]
    with pytest.raises(KeyError):
        series.read_wide_csv(spark, str(tmp_path / "w.csv"), ["rain (mm)"])
    (tmp_path / "s.csv").write_text("timestamp,id,value\n2014-07-01 00:00:00,3,NaN\n2014-07-01 00:30:00,4,5\n")
    rows = series.read_series_csv(spark, str(tmp_path / "s.csv")).collect()
    assert [r["value"] for r in rows] == [None, 5.0]


def test_profile_counts_non_null(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    got = {r["column"]: (r["type"], r["non_null"], r["rows"]) for r in series.profile(df).collect()}
    assert got == {"a": ("int", 2, 2), "b": ("string", 1, 2)}


def numbered(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "line_no long, line string")


def test_context_lines_takes_the_last_marker(spark):
    texts = [f"line {k}" for k in range(1, 61)]
    texts[4] = texts[29] = "Epoch 3/30 completed. (recovery)"
    got = sorted(r["line_no"] for r in lines.context_lines(numbered(spark, texts), "(recovery)").collect())
    assert got == list(range(20, 41))


def test_context_lines_at_the_ends_and_absent(spark):
    texts = ["(recovery)"] + ["x"] * 5
    assert lines.context_lines(numbered(spark, texts), "(recovery)").count() == 6
    assert lines.context_lines(numbered(spark, ["x"] * 5), "(recovery)").count() == 0


def test_log_lines_keep_file_order(spark, tmp_path):
    (tmp_path / "evaluate.log").write_text("".join(f"row {k}\n" for k in range(1000)))
    got = lines.read_log_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r["line"] for r in got] == [f"row {k}" for k in range(1000)]
    assert got[0]["line_no"] == 1

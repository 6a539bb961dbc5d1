from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logmetrics.functions import messages as m
from logmetrics.functions import times as t


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r["y"] for r in df.select("k", function(F.col("x")).alias("y")).orderBy("k").collect()]


def test_clean_message(spark):
    cases = {
        "sshd[2931]: pam_unix(session)  opened": "sshd pam unix session opened",
        "10.0.0.1:22": "",
        "été—42": "été—",
        "\t a\n\nb  ": "a b",
        "'quoted' \\ back": "quoted back",
        "": "",
        "\u00a0a\u2003\u001cb\u3000": "a b",
    }
    assert apply(spark, m.clean_message, list(cases)) == list(cases.values())
    assert apply(spark, m.clean_message, [None]) == [None]


def test_tokenize_default_keeps_runs_of_two(spark):
    got = apply(spark, m.tokenize_default, ["A bc, pam_unix É2 x1-y", "", "a b"])
    assert got == [["bc", "pam_unix", "é2", "x1"], [], []]


def test_tokenize_deleting_punctuation(spark):
    got = apply(spark, m.tokenize_deleting_punctuation, ["Input_userauth:Invalid  a-b", " ... "])
    assert got == [["inputuserauthinvalid", "ab"], []]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [r["g"] for r in df.select(m.ngrams(F.col("t")).alias("g")).collect()]
    assert got == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_concat_text(spark):
    assert apply(spark, lambda c: m.concat_text(c, "error"), ["disk"]) == ["disk error"]


@pytest.mark.parametrize(
    ("x", "prev", "want"),
    [
        (3, False, ["2021-01-01 01:00:00", "2021-01-01 02:00:00", "2021-01-01 03:00:00"]),
        (3, True, ["2020-12-31 22:00:00", "2020-12-31 23:00:00", "2021-01-01 00:00:00"]),
        (0, False, []),
        (0, True, []),
    ],
)
def test_time_grid(spark, x, prev, want):
    got = t.time_grid(spark, x, "2021-01-01 00:00:00", prev=prev).collect()
    assert [r["stamp"] for r in got] == want


def test_time_grid_units(spark):
    got = t.time_grid(spark, 2, "2021-01-01 00:00:00", tick="weeks", step=2).collect()
    assert [r["stamp"] for r in got] == ["2021-01-15 00:00:00", "2021-01-29 00:00:00"]
    with pytest.raises(ValueError):
        t.time_grid(spark, 2, "2021-01-01 00:00:00", tick="years")


def test_make_delta(spark):
    units = ["microseconds", "milliseconds", "seconds", "minutes", "hours", "days", "weeks", "years"]
    got = apply(spark, lambda c: t.make_delta(c, 3), units)
    want = [timedelta(**{u: 3}) for u in units[:-1]] + [None]
    assert got == want
    assert apply(spark, lambda c: t.make_delta(c, -1), ["days"]) == [timedelta(days=-1)]


def test_epoch_round_trip(spark):
    at = datetime(2021, 9, 15, 0, 4, 0, 750000)
    whole = (at - datetime(1970, 1, 1)).total_seconds()
    assert apply(spark, t.to_epoch, [at], "timestamp_ntz") == [int(whole)]
    assert apply(spark, t.to_datetime, [str(whole)]) == [at]
    assert apply(spark, t.epoch_seconds, [at], "timestamp_ntz") == [whole]


def test_to_millis_half_to_even(spark):
    assert apply(spark, t.to_millis, [0.0025, 0.0035, 1.5], "double") == [2, 4, 1500]

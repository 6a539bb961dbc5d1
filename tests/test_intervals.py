from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from logmetrics.operators import intervals as iv

BASE = datetime(2021, 9, 15)


def at(minutes):
    return BASE + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows at one time."""
    stamps = [(k, at(100 if k % 3 == 0 else k)) for k in range(600)]
    return spark.createDataFrame(stamps, "id long, ts timestamp_ntz")


def brute(rows, spans):
    return {r["id"]: int(any(a <= r["ts"] <= b for a, b in spans)) for r in rows.collect()}


SPANS = [(at(10), at(20)), (at(15), at(30)), (at(100), at(100)), (at(400), at(390)), (at(500), at(501))]


def test_label_intervals_is_closed(rows):
    found = iv.label_intervals(rows, [iv.Interval(str(k), a, b) for k, (a, b) in enumerate(SPANS)])
    assert {r["id"]: r["event"] for r in found.collect()} == brute(rows, SPANS)


def test_label_without_intervals(rows):
    assert iv.label_intervals(rows, []).filter("event = 1").count() == 0


def test_sweep_equals_brute_force(spark, rows):
    table = spark.createDataFrame(SPANS * 3, "start timestamp_ntz, end timestamp_ntz")
    got = {r["id"]: r["event"] for r in iv.sweep_intervals(rows, table).collect()}
    assert got == brute(rows, SPANS)


@pytest.mark.parametrize("number", [3, 70])
@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_lists_and_tables_of_any_length_agree(spark, rows, number, kind):
    """Open bounds hold nothing, a flag column is replaced, a map column stays."""
    spans = [(at(7 * k), at(7 * k + k % 5)) for k in range(number)]
    table = spark.createDataFrame(spans, "start timestamp_ntz, end timestamp_ntz")
    table = table.union(spark.sql("SELECT timestamp_ntz'2021-09-15 00:00:00', CAST(NULL AS timestamp_ntz)"))
    table = table.select(*[F.col(c).cast(kind).alias(c) for c in ("start", "end")])
    more = rows.withColumns({"event": F.lit(9), "tags": F.create_map(F.lit("a"), F.col("id"))})
    more = more.withColumn("ts", F.col("ts").cast(kind))
    open_end = iv.Interval("open", at(0), None)
    by_list = iv.label_intervals(more, [iv.Interval("x", a, b) for a, b in spans] + [open_end])
    want = brute(rows, spans)
    for out in (iv.label_intervals(more, table), by_list):
        assert sorted(out.columns) == ["event", "id", "tags", "ts"]
        assert {r["id"]: r["event"] for r in out.collect()} == want
        assert all(r["tags"] == {"a": r["id"]} for r in out.collect())


def test_inject_many_intervals(spark):
    faults = [iv.Interval(f"e{k}", at(k % 9), at(k % 9)) for k in range(300)]
    got = {r["time"]: r["message"] for r in iv.inject_events(messages(spark), faults).collect()}
    assert got[at(9)] == "m9" and got[at(0)].endswith("e288 e297")


def messages(spark):
    return spark.createDataFrame(
        [(at(k), f"m{k}") for k in range(10)], "time timestamp_ntz, message string"
    )


def test_inject_overwrites_in_order(spark):
    faults = [
        iv.Interval("warning", at(1), at(4)),
        iv.Interval("error", at(3), at(6)),
        iv.Interval("critical", at(8), at(8)),
    ]
    got = [r["message"] for r in iv.inject_events(messages(spark), faults).orderBy("time").collect()]
    chained = "m1 warning error"
    assert got == ["m0", "m1 warning", "m1 warning", chained, chained, chained, chained, "m7",
                   "m8 critical", "m9"]


def test_inject_needs_a_row_at_the_start(spark):
    with pytest.raises(KeyError):
        iv.inject_events(messages(spark), [iv.Interval("error", at(20), at(30))])


FAULTS = "ord long, event string, start timestamp_ntz, `end` timestamp_ntz, suffix string"


def as_table(spark, faults):
    rows = [(k, f.event, f.start, f.end, f.suffix) for k, f in enumerate(faults)]
    return spark.createDataFrame(rows, FAULTS).repartition(3)


def test_inject_from_a_table_is_the_list_form(spark):
    draw = np.random.default_rng(8)
    frame = spark.createDataFrame(
        [(at(k), None if k % 17 == 3 else f"m{k}", k) for k in range(120)], "time timestamp_ntz, message string, seq long"
    )
    faults = []
    for k in range(80):
        start, length = int(draw.integers(0, 120)), int(draw.integers(0, 60 if k % 5 == 0 else 6))
        suffix = "own text" if k % 3 == 0 else None
        faults.append(iv.Interval(f"e{k}", at(start), at(start + length), suffix))
    faults += [iv.Interval("never", at(5), at(4)), iv.Interval("open", at(6), None), iv.Interval("all", at(0), at(500))]
    faults += [iv.Interval("last", at(9), at(9)), iv.Interval("last again", at(9), at(9))]
    for some in (faults, faults[:20], faults[-2:], []):
        want = {r["seq"]: r["message"] for r in iv.inject_events(frame, some).collect()} if some else {}
        out = iv.inject_events_of_table(frame, as_table(spark, some))
        got = {r["seq"]: r["message"] for r in out.collect()}
        assert out.columns == frame.columns and len(got) == 120
        assert got == (want or {r["seq"]: r["message"] for r in frame.collect()})


def test_inject_from_a_table_needs_a_row_at_the_start(spark):
    with pytest.raises(KeyError, match="interval 1"):
        iv.inject_events_of_table(
            messages(spark), as_table(spark, [iv.Interval("a", at(1), at(2)), iv.Interval("b", at(20), at(30))])
        )


def test_attach_scores_keeps_rows(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(2, 0.5)], "k int, s double")
    assert {tuple(r) for r in iv.attach_scores(a, b, "k").collect()} == {(1, None), (2, 0.5)}

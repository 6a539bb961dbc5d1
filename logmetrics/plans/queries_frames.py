"""Queries over log frames: projections, filters, joins, aggregates, positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from logmetrics.functions import messages as m
from logmetrics.functions import times as t
from logmetrics.operators import intervals as iv
from logmetrics.operators import logs as lg
from logmetrics.operators import positions as pos
from logmetrics.operators.features import vector_sum
from logmetrics.operators.windows import shingle
from logmetrics.plans import inputs as i
from logmetrics.plans.catalog import query
from logmetrics.session import materialize

# --- messages ---------------------------------------------------------------


@query(f"""SELECT doc_id,
  {i.sql_clean("text || chr(160) || ' ' || chr(8195) || 'x' || chr(28)")} AS cleaned
FROM documents""")
def clean_message(spark, sf_dir):
    """Texts end in blanks of other kinds."""
    text = F.concat("text", F.lit("\u00a0 \u2003x\u001c"))
    return i.spread_documents(spark, sf_dir).select("doc_id", m.clean_message(text).alias("cleaned"))


@query(f"""WITH {i.LOGS}
SELECT log_time AS time, {i.sql_clean('message')} AS message, seq, log_type FROM logs""")
def build_log_frame(spark, sf_dir):
    return lg.build_log_frame(i.logs(spark, sf_dir))


@query(f"WITH {i.LOGS} SELECT {i.sql_clean('message')} AS message FROM logs")
def messages(spark, sf_dir):
    return lg.messages(lg.build_log_frame(i.logs(spark, sf_dir)))


@query(f"""WITH {i.LOGS}
SELECT seq, message || ' warning' AS message FROM logs""")
def concat_text(spark, sf_dir):
    return i.logs(spark, sf_dir).select(
        "seq", m.concat_text(F.col("message"), "warning").alias("message")
    )


@query("""SELECT event_id, ts, value FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'""")
def time_range(spark, sf_dir):
    rows = i.events(spark, sf_dir).select("event_id", "ts", "value")
    return lg.time_range(rows, "2024-01-08 00:00:00", "2024-01-15 00:00:00", "ts")


@query(f"WITH {i.MINUTES} SELECT time, message, log_type FROM minutes")
def last_per_key(spark, sf_dir):
    return lg.last_per_key(i.minute_logs(spark, sf_dir))


@query(f"WITH {i.LOGS} SELECT log_time AS time, seq, log_type FROM logs ORDER BY time, seq")
def sort_by_time(spark, sf_dir):
    frame = lg.build_log_frame(i.logs(spark, sf_dir)).select("time", "seq", "log_type")
    return lg.sort_by_time(frame, "seq")


@query("SELECT count(*) AS rows FROM events")
def row_count(spark, sf_dir):
    return lg.row_count(i.events(spark, sf_dir))


@query(f"""WITH {i.LEDGER}
SELECT run_id, epoch, loss FROM ledger
UNION ALL SELECT run_id, epoch, loss * 2.0::DOUBLE FROM ledger""")
def concat_series(spark, sf_dir):
    def part(metric):
        value = F.element_at("metrics", metric).alias("loss")
        return i.ledger(spark, sf_dir).select("run_id", "epoch", value)

    return lg.concat_series(part("loss"), part("val_loss"))


@query("""SELECT coalesce(c_custkey, o_custkey) AS custkey, c_nationkey, orders
FROM customer FULL JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey)
  ON c_custkey = o_custkey""")
def append_columns(spark, sf_dir):
    left = i.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), "c_nationkey"
    )
    right = (
        i.table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("custkey"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    return lg.append_columns(left, right, "custkey")


# --- intervals --------------------------------------------------------------


@query(f"""SELECT event_id, ts, CASE WHEN {i.IN_FAULT} THEN 1 ELSE 0 END AS event
FROM events""")
def label_intervals(spark, sf_dir):
    rows = i.events(spark, sf_dir).select("event_id", "ts")
    return iv.label_intervals(rows, i.FAULTS)


@query("""WITH spans AS (
  SELECT ts AS "start",
    CASE WHEN event_id % 5 <> 0 THEN ts + to_microseconds((value * 1000000)::BIGINT) END AS "end"
  FROM events WHERE event_type = 'signup')
SELECT event_id, ts,
  CASE WHEN EXISTS (SELECT 1 FROM spans WHERE ts BETWEEN "start" AND "end") THEN 1 ELSE 0 END
    AS event
FROM events""")
def label_intervals_of_table(spark, sf_dir):
    """Every fifth interval is open, and the rows have a flag already."""
    rows = i.events(spark, sf_dir)
    micros = F.rint(F.col("value") * F.lit(1e6)).cast("long")
    end = F.when(F.col("event_id") % 5 != 0, F.col("ts") + t.make_delta("microseconds", micros))
    spans = rows.filter(F.col("event_type") == "signup").select(
        F.col("ts").alias("start"), end.alias("end")
    )
    flagged = rows.select("event_id", "ts", F.lit(9).alias("event"))
    return iv.label_intervals(flagged, spans)


INJECT_STARTS = ["2024-01-05 00:00:00", "2024-01-12 00:00:00", "2024-01-12 12:00:00"]


INJECTED = f"""WITH {i.MINUTES},
starts AS (
  SELECT min(time) FILTER (WHERE time >= TIMESTAMP '{INJECT_STARTS[0]}') AS s1,
         min(time) FILTER (WHERE time >= TIMESTAMP '{INJECT_STARTS[1]}') AS s2,
         min(time) FILTER (WHERE time >= TIMESTAMP '{INJECT_STARTS[2]}') AS s3
  FROM minutes),
base AS (
  SELECT s1, s2, s3,
    (SELECT message FROM minutes WHERE time = s1) || ' warning' AS t1,
    (SELECT message FROM minutes WHERE time = s2) || ' error' AS t2
  FROM starts)
SELECT time,
  CASE WHEN time BETWEEN s3 AND s3 + INTERVAL 1 DAY
         THEN CASE WHEN s3 BETWEEN s2 AND s2 + INTERVAL 1 DAY THEN t2
                   ELSE (SELECT message FROM minutes WHERE time = s3) END || ' critical'
       WHEN time BETWEEN s2 AND s2 + INTERVAL 1 DAY THEN t2
       WHEN time BETWEEN s1 AND s1 + INTERVAL 1 DAY THEN t1
       ELSE message END AS message
FROM minutes, base"""


@query(INJECTED)
def inject_events(spark, sf_dir):
    from datetime import datetime, timedelta

    frame = lg.last_per_key(i.minute_logs(spark, sf_dir)).select("time", "message")
    firsts = frame.agg(
        *[F.min(F.when(F.col("time") >= F.lit(s).cast("timestamp_ntz"), F.col("time")))
          for s in INJECT_STARTS]
    ).first()
    faults = [
        iv.Interval(suffix, start, start + timedelta(days=1))
        for suffix, start in zip(("warning", "error", "critical"), firsts, strict=True)
        if isinstance(start, datetime)
    ]
    return iv.inject_events(frame, faults)


@query(INJECTED)
def inject_events_of_table(spark, sf_dir):
    """The same three overlapping faults as a table made of the frame's own times."""
    frame = materialize(lg.last_per_key(i.minute_logs(spark, sf_dir)).select("time", "message"), "frame")
    starts = [
        frame.where(F.col("time") >= F.lit(start).cast("timestamp_ntz")).agg(
            F.lit(number).alias("ord"), F.lit(event).alias("event"), F.min("time").alias("start")
        )
        for number, (event, start) in enumerate(zip(("warning", "error", "critical"), INJECT_STARTS, strict=True))
    ]
    faults = starts[0].unionByName(starts[1]).unionByName(starts[2]).where("start IS NOT NULL")
    faults = faults.withColumns({"end": F.expr("start + INTERVAL 1 DAY"), "suffix": F.lit(None).cast("string")})
    return iv.inject_events_of_table(frame, faults)


@query("""SELECT event_type, event_id, value, CASE WHEN rn >= 48 THEN round(total, 6) END AS score
FROM (SELECT event_type, event_id, value,
        row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn,
        sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
          ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS total
      FROM events)""")
def attach_scores(spark, sf_dir):
    rows = i.events(spark, sf_dir).select("event_type", "ts", "event_id", "value")
    points = shingle(rows, "event_type", "ts", "event_id", series=["event_type"], size=48)
    total = F.round(vector_sum(F.col("features")), 6).alias("score")
    scores = points.select("event_id", total)
    return iv.attach_scores(rows.drop("ts"), scores, "event_id")


# --- positions --------------------------------------------------------------

INDEXED = """indexed AS (
  SELECT event_id, ts, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events)"""


def _series(spark, sf_dir):
    return i.events(spark, sf_dir).select("event_id", "ts", "value")


@query("""SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) - 1 AS idx
FROM events""")
def row_index(spark, sf_dir):
    rows = i.events(spark, sf_dir).select("event_id", "value")
    return pos.row_index(rows, "value", "event_id")


@query(f"WITH {INDEXED} SELECT * FROM indexed WHERE idx >= 5 AND (idx - 5) % 6 = 0")
def sample_every(spark, sf_dir):
    return pos.sample_every(_series(spark, sf_dir), "ts", "event_id")


@query(f"WITH {INDEXED} SELECT * FROM indexed WHERE idx >= 550 AND idx < 6500")
def slice_rows(spark, sf_dir):
    return pos.slice_rows(_series(spark, sf_dir), "ts", "event_id", start=550, stop=6500)


@query("SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 5")
def head_rows(spark, sf_dir):
    return pos.head_rows(_series(spark, sf_dir), "ts", "event_id", n=5)


@query(f"WITH {INDEXED} SELECT event_id, ts, value FROM indexed WHERE idx = 776")
def take_record(spark, sf_dir):
    return pos.take_record(_series(spark, sf_dir), "ts", "event_id", index=777)


@query(f"""WITH {INDEXED}, size AS (SELECT count(*)::DOUBLE AS n FROM events)
SELECT event_id, ts, value, idx,
  CASE WHEN idx < floor(n * 0.7::DOUBLE) THEN 'train'
       WHEN idx < floor(n * 0.9::DOUBLE) THEN 'validation' ELSE 'test' END AS split
FROM indexed, size""")
def chrono_split(spark, sf_dir):
    return pos.chrono_split(_series(spark, sf_dir), "ts", "event_id")


# --- times ------------------------------------------------------------------


@query("""SELECT event_id, strftime(ts + k * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS stamp, k
FROM (SELECT event_id, date_trunc('second', ts) AS ts,
             unnest(range(1, (user_id % 4 + 1)::BIGINT)) AS k FROM events)""")
def time_grid(spark, sf_dir):
    start = F.date_trunc("second", "ts").cast("timestamp_ntz")
    stamps = t.grid_stamps(start, (F.col("user_id") % 4).cast("int"))
    return (
        i.events(spark, sf_dir)
        .select("event_id", F.posexplode(stamps).alias("p", "at"))
        .select(
            "event_id",
            F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("stamp"),
            (F.col("p") + 1).cast("long").alias("k"),
        )
    )


@query("""SELECT event_id, strftime(ts - k * INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS stamp,
       x - 1 - k AS p
FROM (SELECT event_id, date_trunc('second', ts) AS ts, (user_id % 4)::BIGINT AS x,
             unnest(range(0, (user_id % 4)::BIGINT)) AS k FROM events)""")
def time_grid_backward(spark, sf_dir):
    start = F.date_trunc("second", "ts").cast("timestamp_ntz")
    x = (F.col("user_id") % 4).cast("int")
    stamps = t.grid_stamps(start, x, prev=True, tick="minutes", step=30)
    return (
        i.events(spark, sf_dir)
        .select("event_id", F.posexplode(stamps).alias("p", "at"))
        .select(
            "event_id",
            F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("stamp"),
            F.col("p").cast("long").alias("p"),
        )
    )


@query("""SELECT event_id,
  CASE unit WHEN 'microseconds' THEN ts + to_microseconds(n)
            WHEN 'milliseconds' THEN ts + to_microseconds(n * 1000)
            WHEN 'seconds' THEN ts + to_microseconds(n * 1000000)
            WHEN 'minutes' THEN ts + to_microseconds(n * 60000000)
            WHEN 'hours' THEN ts + to_microseconds(n * 3600000000)
            WHEN 'days' THEN ts + to_microseconds(n * 86400000000)
            WHEN 'weeks' THEN ts + to_microseconds(n * 604800000000) END AS moved
FROM (SELECT event_id, ts, user_id % 50 - 25 AS n,
        (['microseconds', 'milliseconds', 'seconds', 'minutes', 'hours', 'days', 'weeks',
          'years'])[event_id % 8 + 1] AS unit FROM events)""")
def make_delta(spark, sf_dir):
    units = F.array(*[F.lit(u) for u in [*t.UNIT_MICROS, "years"]])
    unit = F.get(units, (F.col("event_id") % 8).cast("int"))
    moved = F.col("ts") + t.make_delta(unit, F.col("user_id") % 50 - 25)
    return i.events(spark, sf_dir).select("event_id", moved.alias("moved"))


@query("""SELECT event_id, epoch_us(ts) // 1000000 AS epoch,
  make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS back FROM events""")
def epoch_round_trip(spark, sf_dir):
    epoch = t.to_epoch(F.col("ts"))
    return i.events(spark, sf_dir).select(
        "event_id", epoch.alias("epoch"), t.to_datetime(epoch).alias("back")
    )


@query("""SELECT event_id, round_even(value * 1000.0::DOUBLE / 16.0::DOUBLE, 0)::BIGINT AS millis
FROM events""")
def to_millis(spark, sf_dir):
    return i.events(spark, sf_dir).select(
        "event_id", t.to_millis(F.col("value") / F.lit(16.0)).alias("millis")
    )

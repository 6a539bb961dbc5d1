"""Queries over overlapping row windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from logmetrics.operators import windows as w
from logmetrics.operators.positions import chrono_split
from logmetrics.plans import inputs as i
from logmetrics.plans.catalog import query
from logmetrics.session import materialize

SPEC = w.WindowSpec(columns=("value", "user_id"), label_columns=("value",))


@query("""WITH s AS (
  SELECT event_type, event_id, CASE WHEN event_id % 97 <> 0 THEN value END AS value,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn
  FROM events),
win AS (
  SELECT event_type, event_id, rn, list(value) OVER (
    PARTITION BY event_type ORDER BY rn ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS v
  FROM s)
SELECT event_type, event_id, unnest(range(0, 48)) AS pos, unnest(v) AS x FROM win WHERE rn >= 48""")
def shingle(spark, sf_dir):
    value = F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("value")
    rows = i.events(spark, sf_dir).select("event_type", "ts", "event_id", value)
    points = w.shingle(rows, "event_type", "ts", "event_id", series=["event_type"], size=48)
    return points.select(
        "event_type", "event_id", F.posexplode("features").alias("pos", "x")
    ).withColumn("pos", F.col("pos").cast("long"))


ROWS = """indexed AS (
  SELECT event_id, value::FLOAT::DOUBLE AS value, user_id::FLOAT::DOUBLE AS user_id,
         row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events),
size AS (SELECT count(*)::DOUBLE AS n FROM events),
rows AS (
  SELECT idx, value, user_id, CASE WHEN idx < floor(n * 0.7::DOUBLE) THEN 'train'
    WHEN idx < floor(n * 0.9::DOUBLE) THEN 'validation' ELSE 'test' END AS split
  FROM indexed, size),
starts AS (
  SELECT split, idx FROM (
    SELECT split, idx, max(idx) OVER (PARTITION BY split) AS last FROM rows)
  WHERE idx + 24 <= last)"""


def _windows(spark, sf_dir):
    rows = i.events(spark, sf_dir).select("event_id", "ts", "value", "user_id")
    return w.sliding_windows(chrono_split(rows, "ts", "event_id"), SPEC)


@query(f"""WITH {ROWS}
SELECT s.split, s.idx, r.idx - s.idx AS place, r.value, r.user_id
FROM starts s JOIN rows r ON r.idx BETWEEN s.idx AND s.idx + 24""")
def sliding_windows(spark, sf_dir):
    entries = _windows(spark, sf_dir).select(
        "split", "idx", F.posexplode("window").alias("place", "row")
    )
    return entries.select(
        "split", "idx", F.col("place").cast("long").alias("place"),
        F.col("row")[0].cast("double").alias("value"),
        F.col("row")[1].cast("double").alias("user_id"),
    )


@query(f"""WITH {ROWS}
SELECT s.split, s.idx, 24::BIGINT AS n_inputs, 1::BIGINT AS n_labels,
       a.value AS first_value, b.user_id AS last_user, c.value AS label
FROM starts s JOIN rows a ON a.idx = s.idx JOIN rows b ON b.idx = s.idx + 23
JOIN rows c ON c.idx = s.idx + 24""")
def window_slices(spark, sf_dir):
    parts = w.window_slices(_windows(spark, sf_dir), SPEC)
    return parts.select(
        "split", "idx",
        F.size("inputs").cast("long").alias("n_inputs"),
        F.size("labels").cast("long").alias("n_labels"),
        F.col("inputs")[0][0].cast("double").alias("first_value"),
        F.col("inputs")[23][1].cast("double").alias("last_user"),
        F.col("labels")[0][0].cast("double").alias("label"),
    )


@query(f"""WITH {ROWS}
SELECT s.split, s.idx, r.value AS label
FROM starts s JOIN rows r ON r.idx = s.idx + 24 WHERE s.split = 'validation'""")
def split_dataset(spark, sf_dir):
    held = w.split_dataset(_windows(spark, sf_dir), "validation")
    return w.window_slices(held, SPEC).select(
        "split", "idx", F.col("labels")[0][0].cast("double").alias("label")
    )


@query("""SELECT event_id, pos, pos // 12 AS batch FROM (
  SELECT event_id, row_number() OVER (ORDER BY md5('11:0:' || event_id), event_id) - 1 AS pos
  FROM events)""")
def shuffle_batches(spark, sf_dir):
    rows = i.events(spark, sf_dir).select("event_id")
    return w.shuffle_batches(rows, "event_id", batch_size=SPEC.batch_size, seed=11)


@query(f"""WITH {ROWS},
train AS (SELECT idx FROM starts WHERE split = 'train'),
batches AS (SELECT idx, (row_number() OVER (ORDER BY md5('5:0:' || idx), idx) - 1) // 12 AS batch
            FROM train)
SELECT idx, batch, r.value AS label
FROM batches JOIN rows r USING (idx) WHERE batch = 0""".replace(
    "JOIN rows r USING (idx)", "JOIN (SELECT idx - 24 AS idx, value FROM rows) r USING (idx)"))
def example_batch(spark, sf_dir):
    train = materialize(w.split_dataset(_windows(spark, sf_dir), "train"), "train")
    batches = w.shuffle_batches(train, "idx", batch_size=SPEC.batch_size, seed=5)
    first = w.window_slices(w.example_batch(batches), SPEC)
    return first.select("idx", "batch", F.col("labels")[0][0].cast("double").alias("label"))

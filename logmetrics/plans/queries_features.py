"""Queries over feature columns and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from logmetrics.operators import features as f
from logmetrics.operators.intervals import label_intervals
from logmetrics.operators.positions import chrono_split
from logmetrics.plans import inputs as i
from logmetrics.plans.catalog import query

SPEEDS = ["wv (m/s)", "max. wv (m/s)"]
STEMS = {"wv (m/s)": "W", "max. wv (m/s)": "max W"}


def _round(df, *columns):
    return df.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in columns})


@query(f"""WITH {i.WEATHER}
SELECT event_id,
  CASE WHEN "wv (m/s)" = -9999.0 THEN 0.0 ELSE "wv (m/s)" END::DOUBLE AS wv,
  CASE WHEN "max. wv (m/s)" = -9999.0 THEN 0.0 ELSE "max. wv (m/s)" END::DOUBLE AS max_wv
FROM weather""")
def replace_sentinel(spark, sf_dir):
    fixed = f.replace_sentinel(i.weather(spark, sf_dir), SPEEDS)
    return fixed.select(
        "event_id", F.col("`wv (m/s)`").alias("wv"), F.col("`max. wv (m/s)`").alias("max_wv")
    )


@query(f"""WITH {i.WEATHER},
a AS (SELECT *, "wd (deg)" * pi() / 180 AS rad FROM weather)
SELECT event_id,
  round("wv (m/s)" * cos(rad), 6) AS "Wx", round("wv (m/s)" * sin(rad), 6) AS "Wy",
  round("max. wv (m/s)" * cos(rad), 6) AS "max Wx",
  round("max. wv (m/s)" * sin(rad), 6) AS "max Wy"
FROM a""")
def polar_to_xy(spark, sf_dir):
    xy = f.polar_to_xy(i.weather(spark, sf_dir), STEMS, "wd (deg)")
    return _round(xy, "Wx", "Wy", "max Wx", "max Wy").select(
        "event_id", "Wx", "Wy", "max Wx", "max Wy"
    )


@query("""WITH s AS (SELECT event_id, epoch_us(ts) / 1000000.0::DOUBLE AS s FROM events)
SELECT event_id,
  round(sin(s * (2.0::DOUBLE * pi() / 86400.0::DOUBLE)), 6) AS "Day sin",
  round(cos(s * (2.0::DOUBLE * pi() / 86400.0::DOUBLE)), 6) AS "Day cos",
  round(sin(s * (2.0::DOUBLE * pi() / 31556952.0::DOUBLE)), 6) AS "Year sin",
  round(cos(s * (2.0::DOUBLE * pi() / 31556952.0::DOUBLE)), 6) AS "Year cos"
FROM s""")
def cyclic_time(spark, sf_dir):
    out = f.cyclic_time(i.events(spark, sf_dir).select("event_id", "ts"), "ts").drop("ts")
    return _round(out, "Day sin", "Day cos", "Year sin", "Year cos")


@query(f'WITH {i.WEATHER} SELECT event_id, "T (degC)" FROM weather')
def drop_columns(spark, sf_dir):
    return f.drop_columns(i.weather(spark, sf_dir), "Date Time", *SPEEDS, "wd (deg)")


@query("SELECT event_id, value / 1000.0::DOUBLE AS thousands FROM events")
def scale_constant(spark, sf_dir):
    return i.events(spark, sf_dir).select(
        "event_id", f.scale_constant(F.col("value"), 1000).alias("thousands")
    )


def _matrix(spark, sf_dir):
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("features", r * 8 + 1, F.lit(8))
    )
    return i.vectors(spark, sf_dir).select("vec_id", rows.alias("pixels"))


@query("""SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k,
  unnest(embedding)::DOUBLE AS x FROM embeddings""")
def flatten_matrix(spark, sf_dir):
    flat = _matrix(spark, sf_dir).select(
        "vec_id", F.posexplode(f.flatten_matrix(F.col("pixels"))).alias("k", "x")
    )
    return flat.withColumn("k", F.col("k").cast("long"))


@query("""SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k,
  unnest(embedding)::DOUBLE / 255.0::DOUBLE AS x FROM embeddings""")
def scale_pixels(spark, sf_dir):
    flat = _matrix(spark, sf_dir).select(
        "vec_id", F.posexplode(f.scale_pixels(F.col("pixels"))).alias("k", "x")
    )
    return flat.withColumn("k", F.col("k").cast("long"))


@query("""SELECT event_id, user_id::DOUBLE AS user_id, value::FLOAT::DOUBLE AS value
FROM events""")
def cast_numeric(spark, sf_dir):
    rows = i.events(spark, sf_dir).select("event_id", "user_id", "value")
    narrow = f.cast_numeric(f.cast_numeric(rows, ["user_id"]), ["value"], "float")
    return narrow.withColumn("value", F.element_at(f.as_vector("value"), 1))


@query(f"""WITH {i.WEATHER}
SELECT event_id, 3::BIGINT AS place, "T (degC)" AS label FROM weather""")
def feature_columns(spark, sf_dir):
    places = f.label_positions(i.WEATHER_COLUMNS, ["T (degC)"])
    vector = f.as_vector(*i.WEATHER_COLUMNS)
    return i.weather(spark, sf_dir).select(
        "event_id", F.lit(places[0]).cast("long").alias("place"), vector[places[0]].alias("label")
    )


@query("""WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT event_id, round((value - lo) / nullif(hi - lo, 0), 6) AS value,
       NULL::DOUBLE AS flat
FROM events, b""")
def minmax_normalize(spark, sf_dir):
    rows = i.events(spark, sf_dir).select("event_id", "value", F.lit(3.0).alias("flat"))
    return _round(f.minmax_normalize(rows, ["value", "flat"]), "value")


SPLIT = """indexed AS (
  SELECT event_id, value, user_id::DOUBLE AS user_id,
         row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events),
size AS (SELECT count(*)::DOUBLE AS n FROM events),
split AS (
  SELECT event_id, value, user_id, CASE WHEN idx < floor(n * 0.7::DOUBLE) THEN 'train'
    WHEN idx < floor(n * 0.9::DOUBLE) THEN 'validation' ELSE 'test' END AS split
  FROM indexed, size),
stats AS (
  SELECT avg(value) AS mean_0, stddev_samp(value) AS std_0,
         avg(user_id) AS mean_1, stddev_samp(user_id) AS std_1
  FROM split WHERE split = 'train')"""


def _split(spark, sf_dir):
    rows = i.events(spark, sf_dir).select(
        "event_id", "ts", "value", F.col("user_id").cast("double").alias("user_id")
    )
    return chrono_split(rows, "ts", "event_id").select("event_id", "value", "user_id", "split")


def _stats(rows):
    return f.fit_zscore(rows, ["value", "user_id"], F.col("split") == "train")


@query(f"""WITH {SPLIT}
SELECT round(mean_0, 6) AS mean_0, round(std_0, 6) AS std_0,
       round(mean_1, 6) AS mean_1, round(std_1, 6) AS std_1 FROM stats""")
def fit_zscore(spark, sf_dir):
    return _round(_stats(_split(spark, sf_dir)), "mean_0", "std_0", "mean_1", "std_1")


@query(f"""WITH {SPLIT}
SELECT event_id, split, round((value - mean_0) / std_0, 6) AS value,
       round((user_id - mean_1) / std_1, 6) AS user_id
FROM split, stats""")
def apply_zscore(spark, sf_dir):
    rows = _split(spark, sf_dir)
    out = f.apply_zscore(rows, _stats(rows), ["value", "user_id"])
    return _round(out, "value", "user_id")


@query("SELECT event_id, value, user_id::DOUBLE AS user_id FROM events")
def inverse_zscore(spark, sf_dir):
    rows = _split(spark, sf_dir)
    stats = _stats(rows)
    columns = ["value", "user_id"]
    there = f.apply_zscore(rows, stats, columns)
    back = f.apply_zscore(there, stats, columns, inverse=True)
    return _round(back, *columns).select("event_id", *columns)


@query(f"""SELECT sum(CASE WHEN {i.IN_FAULT} THEN 1 ELSE 0 END)::DOUBLE / count(*)
  AS contamination FROM events""")
def contamination(spark, sf_dir):
    return f.contamination(label_intervals(i.events(spark, sf_dir), i.FAULTS))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total
FROM embeddings""")
def vector_sum(spark, sf_dir):
    summed = i.vectors(spark, sf_dir).select(
        "vec_id", f.vector_sum(F.col("features")).alias("total")
    )
    return _round(summed, "total")


@query("""SELECT least(min(value), min(user_id::DOUBLE)) - 0.15::DOUBLE AS low,
  greatest(max(value), max(user_id::DOUBLE)) + 0.15::DOUBLE AS high FROM events""")
def axis_bounds(spark, sf_dir):
    rows = i.events(spark, sf_dir).select("value", F.col("user_id").cast("double").alias("user_id"))
    return f.axis_bounds(rows, ["value", "user_id"], 0.15)

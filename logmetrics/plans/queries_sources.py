"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from logmetrics.functions.times import to_datetime
from logmetrics.operators.positions import take_entry
from logmetrics.plans import inputs as i
from logmetrics.plans.catalog import query
from logmetrics.session import scratch_path
from logmetrics.sources import ledger as store
from logmetrics.sources import lines, logs, logstore, series


@query(f"""WITH {i.ENVELOPES}
SELECT log_type, 'search-' || page AS "searchTime", pos::BIGINT AS pos, log_time, message
FROM pages_of""")
def read_log_envelopes(spark, sf_dir):
    path = i.landed_envelopes(spark, sf_dir)
    rows = logs.read_log_envelopes(spark, path, multi_line=False)
    return rows.select("log_type", "searchTime", "pos", "log_time", "message")


SEARCH = f"""WITH {i.LOGS}
SELECT seq, log_time, log_type, message FROM logs
WHERE log_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'
  AND log_type = 'error' AND contains(message, '%s')"""


@query(SEARCH % "[4")
def search_logs(spark, sf_dir):
    return logs.search_logs(
        i.logs(spark, sf_dir),
        "2024-01-05 00:00:00",
        "2024-01-20 12:00:00",
        log_type="error",
        message="[4",
    )


@query(SEARCH % "error[42")
def search_landed_logs(spark, sf_dir):
    """All log rows landed by date and type, then searched through the side table."""
    path = scratch_path(spark, "store")
    logstore.land_logs(i.logs(spark, sf_dir), path)
    found = logstore.search_store(
        spark, path, "2024-01-05 00:00:00", "2024-01-20 12:00:00", log_type="error", message="error[42"
    )
    return found.select("seq", "log_time", "log_type", "message")


@query(f"""WITH {i.ENVELOPES}
SELECT log_type, "searchTime", "logCount", "is_VALID", "invalid_MSG",
       "logCount" = listed AS valid
FROM envelopes""")
def envelope_header(spark, sf_dir):
    path = i.landed_envelopes(spark, sf_dir)
    return logs.envelope_header(logs.read_envelopes(spark, path, multi_line=False))


@query("SELECT ts, CASE WHEN event_id % 11 <> 0 THEN value END AS value FROM events")
def read_series_csv(spark, sf_dir):
    """The value stands behind another number, and every eleventh is NaN."""
    path = scratch_path(spark, "series")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp")
    value = F.when(F.col("event_id") % 11 == 0, float("nan")).otherwise(F.col("value")).alias("value")
    i.events(spark, sf_dir).select(stamp, "user_id", value).write.csv(path, header=True)
    return series.read_series_csv(spark, path, time_format="yyyy-MM-dd HH:mm:ss.SSSSSS")


@query(f"""WITH {i.WEATHER}
SELECT date_trunc('second', "Date Time") AS "Date Time", "wv (m/s)", "max. wv (m/s)",
       "wd (deg)", CASE WHEN hour("Date Time") <> 5 THEN "T (degC)" END AS "T (degC)"
FROM weather""")
def read_wide_csv(spark, sf_dir):
    """The file has one more column, the others in another order, and NaN."""
    path = scratch_path(spark, "wide")
    stamp = F.date_format("Date Time", "dd.MM.yyyy HH:mm:ss").alias("Date Time")
    weather = i.weather(spark, sf_dir)
    degrees = F.when(F.hour("Date Time") == 5, float("nan")).otherwise(F.col("T (degC)"))
    weather = weather.withColumn("T (degC)", degrees)
    numbers = [F.col(f"`{c}`") for c in reversed(i.WEATHER_COLUMNS)]
    weather.select(stamp, F.lit(996.5).alias("p (mbar)"), *numbers).write.csv(path, header=True)
    return series.read_wide_csv(spark, path, i.WEATHER_COLUMNS)


@query("""WITH t AS (SELECT count(*) AS rows, count(event_id) AS c0, count(ts) AS c1,
  count(user_id) AS c2, count(event_type) AS c3, count(value) AS c4, count(props) AS c5
  FROM events)
SELECT 0::BIGINT AS position, 'event_id' AS "column", 'bigint' AS type, c0 AS non_null, rows FROM t
UNION ALL SELECT 1, 'ts', 'timestamp_ntz', c1, rows FROM t
UNION ALL SELECT 2, 'user_id', 'bigint', c2, rows FROM t
UNION ALL SELECT 3, 'event_type', 'string', c3, rows FROM t
UNION ALL SELECT 4, 'value', 'double', c4, rows FROM t
UNION ALL SELECT 5, 'props', 'string', c5, rows FROM t""")
def profile(spark, sf_dir):
    return series.profile(i.events(spark, sf_dir))


@query("""WITH x AS (
  SELECT vec_id AS id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k
  FROM embeddings)
SELECT id, (k // 8)::BIGINT AS row, (k % 8)::BIGINT AS col,
       floor((v::DOUBLE + 1) * 127)::INTEGER AS pixel, label,
       CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END AS split
FROM x""")
def read_images(spark, sf_dir):
    path = scratch_path(spark, "images")
    pixel = F.transform("features", lambda x: F.floor((x + 1) * 127).cast("int"))
    matrix = F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("_flat", r * 8 + 1, F.lit(8))
    )
    split = F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train")
    flat = i.vectors(spark, sf_dir).withColumn("_flat", pixel)
    flat.select(
        F.col("vec_id").alias("id"), matrix.alias("pixels"), "label", split.alias("split")
    ).write.parquet(path)
    images = series.read_images(spark, path)
    rows = images.select("id", "label", "split", F.posexplode("pixels").alias("row", "line"))
    return rows.select("id", "label", "split", "row", F.posexplode("line").alias("col", "pixel")).select(
        "id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"),
        "pixel", "label", "split",
    )


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def write_json(spark, sf_dir):
    path = scratch_path(spark, "json")
    logs.write_json(i.events(spark, sf_dir), path)
    schema = (
        "event_id bigint, ts string, user_id bigint, event_type string, value double, props string"
    )
    return spark.read.schema(schema).json(path).withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )


SQL_LINES = """doc_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM documents)"""


@query(f"""WITH {SQL_LINES}
SELECT row_number() OVER (ORDER BY doc_id, n) AS line_no, line FROM doc_lines""")
def read_log_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    numbered = lines.split_lines(i.documents(spark, sf_dir), "text", "doc_id")
    numbered.orderBy("doc_id", "line_no").select("line").write.option("lineSep", "\n").text(path)
    return lines.read_log_lines(spark, path)


@query(f"""WITH {SQL_LINES},
numbered AS (
  SELECT row_number() OVER (ORDER BY doc_id, n) AS line_no, line FROM doc_lines),
point AS (SELECT max(line_no) AS p FROM numbered WHERE contains(line, 'MIT License'))
SELECT line_no, line FROM numbered, point WHERE line_no BETWEEN p - 10 AND p + 10""")
def context_lines(spark, sf_dir):
    return lines.context_lines(_numbered_lines(spark, sf_dir), "MIT License")


@query(f"""WITH {SQL_LINES}
SELECT row_number() OVER (ORDER BY doc_id, n) AS line_no, line FROM doc_lines
ORDER BY line_no DESC LIMIT 30""")
def tail_lines(spark, sf_dir):
    from logmetrics.operators.positions import tail_numbered

    split = lines.split_lines(i.documents(spark, sf_dir), "text", "doc_id")
    numbered = split.withColumnRenamed("line_no", "n")
    return tail_numbered(numbered, "doc_id", "n", n=30).select("line_no", "line")


def _numbered_lines(spark, sf_dir):
    from logmetrics.operators.positions import row_index

    split = lines.split_lines(i.documents(spark, sf_dir), "text", "doc_id")
    return row_index(split.withColumnRenamed("line_no", "n"), "doc_id", "n").select(
        (F.col("idx") + 1).alias("line_no"), "line"
    )


@query(f"""WITH {i.LEDGER},
last AS (
  SELECT run_id, max(seq) AS seq, arg_max(acc, seq) AS acc, arg_max(epoch, seq) AS epochs,
         arg_max(max_epochs, seq) AS max_epochs, arg_max(recovery, seq) AS recovery
  FROM ledger GROUP BY run_id),
wanted AS (SELECT DISTINCT 'run' || (user_id * 2) AS run_id FROM events)
SELECT run_id, coalesce(seq, 0) AS seq, coalesce(acc, 0) AS acc, coalesce(epochs, 0) AS epochs,
       coalesce(max_epochs, 0) AS max_epochs, coalesce(recovery, false) AS recovery
FROM wanted LEFT JOIN last USING (run_id)""")
def ledger_read(spark, sf_dir):
    path = scratch_path(spark, "ledger")
    store.ledger_append(i.ledger(spark, sf_dir), path)
    wanted = i.events(spark, sf_dir).select(
        F.concat(F.lit("run"), (F.col("user_id") * 2).cast("string")).alias("run_id")
    ).distinct()
    return store.ledger_read(store.ledger_rows(spark, path), wanted)


@query(f"""WITH {i.LEDGER}
SELECT run_id, arg_max(epoch, seq) AS epoch FROM ledger WHERE recovery GROUP BY run_id""")
def latest_checkpoint(spark, sf_dir):
    return store.latest_checkpoint(i.ledger(spark, sf_dir))


@query(f"""WITH {i.ENVELOPES}
SELECT p.log_type, "searchTime", log_time, message
FROM pages_of p JOIN envelopes e ON p.log_type = e.log_type AND p.page = e.page
WHERE pos = 2""")
def take_record_of_envelope(spark, sf_dir):
    taken = i.envelopes(spark, sf_dir).withColumn("r", take_entry(F.col("logCmpList"), 3))
    return taken.filter(F.col("r").isNotNull()).select(
        "log_type",
        "searchTime",
        F.to_timestamp_ntz("r.log_time", F.lit(logs.TIME_FORMAT)).alias("log_time"),
        F.col("r.message").alias("message"),
    )


@query("""SELECT event_id,
  CASE WHEN event_id % 4 IN (1, 2) THEN NULL
       ELSE (props::JSON ->> 'k')::BIGINT END AS k,
  CASE WHEN event_id % 4 = 1 THEN ' ' WHEN event_id % 8 = 2 THEN 'plain text ' || event_id
       WHEN event_id % 8 = 6 THEN '{"k": ' END AS raw
FROM events""")
def json_parse(spark, sf_dir):
    """Bodies that are JSON, blank, plain text and cut off."""
    number = F.col("event_id")
    body = (
        F.when(number % 4 == 1, " ")
        .when(number % 8 == 2, F.concat(F.lit("plain text "), number.cast("string")))
        .when(number % 8 == 6, '{"k": ')
        .otherwise(F.col("props"))
    )
    bodies = i.events(spark, sf_dir).select("event_id", body.alias("body"))
    parsed = logs.json_parse(bodies, "body", "k bigint")
    return parsed.select("event_id", F.col("parsed.k").alias("k"), "raw")


@query("SELECT event_id, to_timestamp_at AS at FROM (SELECT event_id, "
       "make_timestamp((user_id * 1000000 + 250000)::BIGINT) AS to_timestamp_at FROM events)")
def to_datetime_from_text(spark, sf_dir):
    text = F.concat(F.col("user_id").cast("string"), F.lit(".25"))
    return i.events(spark, sf_dir).select("event_id", to_datetime(text).alias("at"))

"""The test tables as inputs of the operators, in Spark and as SQL for the checks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmetrics.functions.messages import BLANK_CLASS, DIGITS, PUNCTUATION, tokenize_default
from logmetrics.operators.intervals import Interval
from logmetrics.operators.logs import build_log_frame
from logmetrics.session import scratch_path, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for per-row text work, over all cores whatever the file layout."""
    return spread(documents(spark, sf_dir), "doc_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"), "label"
    )


# --- log rows ---------------------------------------------------------------

LOGS = """logs AS (
  SELECT event_id AS seq, ts AS log_time, event_type AS log_type,
         'localhost ' || event_type || '[' || user_id || ']: ' || props AS message
  FROM events)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_rows(events(spark, sf_dir))


def log_rows(rows: DataFrame) -> DataFrame:
    message = F.concat(
        F.lit("localhost "), "event_type", F.lit("["), F.col("user_id").cast("string"),
        F.lit("]: "), "props",
    )
    return rows.select(
        F.col("event_id").alias("seq"),
        F.col("ts").alias("log_time"),
        F.col("event_type").alias("log_type"),
        message.alias("message"),
    )


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_clean(column: str) -> str:
    """SQL form of clean_message."""
    marks = PUNCTUATION + DIGITS
    spaced = f"translate({column}, {sql_text(marks)}, '{' ' * len(marks)}')"
    return f"trim(regexp_replace({spaced}, '{BLANK_CLASS}', ' ', 'g'))"


# One log frame per minute, some messages null, to exercise last-value-per-key.
MINUTES = f"""{LOGS},
minute_logs AS (
  SELECT date_trunc('minute', log_time) AS time, seq,
         CASE WHEN seq % 5 <> 0 THEN {sql_clean('message')} END AS message,
         CASE WHEN seq % 7 <> 0 THEN log_type END AS log_type
  FROM logs),
minutes AS (
  SELECT time,
         arg_max(message, seq) FILTER (WHERE message IS NOT NULL) AS message,
         arg_max(log_type, seq) FILTER (WHERE log_type IS NOT NULL) AS log_type
  FROM minute_logs GROUP BY time)"""


def minute_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_minute(build_log_frame(logs(spark, sf_dir)))


def by_minute(frame: DataFrame) -> DataFrame:
    return frame.select(
        F.date_trunc("minute", "time").cast("timestamp_ntz").alias("time"),
        "seq",
        F.when(F.col("seq") % 5 != 0, F.col("message")).alias("message"),
        F.when(F.col("seq") % 7 != 0, F.col("log_type")).alias("log_type"),
    )


# --- landed responses -------------------------------------------------------

# A page never holds more than 250 records, whatever the type's share of rows.
ENVELOPES = f"""{LOGS},
pages_of AS (
  SELECT *, seq // 250 AS page,
         row_number() OVER (PARTITION BY log_type, seq // 250 ORDER BY seq) - 1 AS pos
  FROM logs),
envelopes AS (
  SELECT log_type, page, 'search-' || page AS "searchTime",
         count(*) + CASE WHEN page % 7 = 0 THEN 1 ELSE 0 END AS "logCount",
         page % 5 <> 0 AS "is_VALID",
         CASE WHEN page % 5 = 0 THEN 'invalid' ELSE '' END AS "invalid_MSG",
         count(*) AS listed
  FROM pages_of GROUP BY log_type, page)"""


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.expr("seq div 250")
    record = F.struct(
        "seq",
        F.date_format("log_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("log_time"),
        "message",
    )
    grouped = (
        logs(spark, sf_dir)
        .groupBy("log_type", page.alias("page"))
        .agg(F.sort_array(F.collect_list(record)).alias("_records"))
    )
    return grouped.select(
        F.concat(F.lit("search-"), F.col("page").cast("string")).alias("searchTime"),
        (F.size("_records") + F.when(F.col("page") % 7 == 0, 1).otherwise(0))
        .cast("long")
        .alias("logCount"),
        (F.col("page") % 5 != 0).alias("is_VALID"),
        F.when(F.col("page") % 5 == 0, "invalid").otherwise("").alias("invalid_MSG"),
        "log_type",
        F.transform("_records", lambda r: r.dropFields("seq")).alias("logCmpList"),
    )


def landed_envelopes(spark: SparkSession, sf_dir: str) -> str:
    """Write the responses as JSON lines to the shared folder."""
    path = scratch_path(spark, "envelopes")
    envelopes(spark, sf_dir).write.json(path)
    return path


# --- series and weather -----------------------------------------------------

WEATHER_COLUMNS = ["wv (m/s)", "max. wv (m/s)", "wd (deg)", "T (degC)"]

WEATHER = """weather AS (
  SELECT event_id, ts AS "Date Time",
         CASE WHEN user_id % 17 = 0 THEN -9999.0::DOUBLE ELSE value END AS "wv (m/s)",
         CASE WHEN user_id % 19 = 0 THEN -9999.0::DOUBLE ELSE value * 1.5::DOUBLE END
           AS "max. wv (m/s)",
         ((user_id * 37) % 360)::DOUBLE AS "wd (deg)",
         value / 10.0::DOUBLE - 5.0::DOUBLE AS "T (degC)"
  FROM events)"""


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.lit(-9999.0)
    return events(spark, sf_dir).select(
        "event_id",
        F.col("ts").alias("Date Time"),
        F.when(F.col("user_id") % 17 == 0, missing).otherwise(F.col("value")).alias("wv (m/s)"),
        F.when(F.col("user_id") % 19 == 0, missing)
        .otherwise(F.col("value") * F.lit(1.5))
        .alias("max. wv (m/s)"),
        ((F.col("user_id") * 37) % 360).cast("double").alias("wd (deg)"),
        (F.col("value") / F.lit(10.0) - F.lit(5.0)).alias("T (degC)"),
    )


# --- event intervals --------------------------------------------------------

FAULTS = [
    Interval("maintenance", datetime(2024, 1, 3, 6), datetime(2024, 1, 3, 18)),
    Interval("outage", datetime(2024, 1, 10, 0), datetime(2024, 1, 11, 12)),
    Interval("recovery", datetime(2024, 1, 11, 6), datetime(2024, 1, 12, 0)),
]

IN_FAULT = " OR ".join(
    f"ts BETWEEN TIMESTAMP '{i.start}' AND TIMESTAMP '{i.end}'" for i in FAULTS
)


# --- text -------------------------------------------------------------------

SQL_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"

TERMS = f"""words AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
terms AS (
  SELECT doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]))
    AS term
  FROM words),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
corpus AS (SELECT count(*) AS n FROM documents)"""

PUNCT_SQL = sql_text(PUNCTUATION)
SQL_BARE_WORDS = (
    f"list_filter(regexp_split_to_array(translate(lower(text), {PUNCT_SQL}, ''), "
    f"'{BLANK_CLASS}'), lambda t: t <> '')"
)

# Word vectors for half of the words, by a hash of the word.
WORD_VECTORS = """word_list AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(message), '[\\p{L}\\p{N}_]{2,}')) AS token
  FROM logs),
word_vectors AS (
  SELECT token, embedding AS vector
  FROM word_list JOIN embeddings
    ON vec_id = ('0x' || substr(md5(token), 1, 7))::BIGINT
              % (SELECT count(*) FROM embeddings)
  WHERE ('0x' || substr(md5(token), 8, 1))::BIGINT % 2 = 0)"""


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = (
        logs(spark, sf_dir)
        .select(F.explode(tokenize_default(F.col("message"))).alias("token"))
        .distinct()
    )
    stored = table(spark, sf_dir, "embeddings")
    size = stored.agg(F.count(F.lit(1)).alias("n")).scalar()

    def hash_part(start: int, length: int):
        digits = F.substring(F.md5(F.col("token").cast("binary")), start, length)
        return F.conv(digits, 16, 10).cast("long")

    return (
        words.filter(hash_part(8, 1) % 2 == 0)
        .withColumn("vec_id", hash_part(1, 7) % size)
        .join(stored, "vec_id")
        .select("token", F.col("embedding").alias("vector"))
    )


# --- run ledger -------------------------------------------------------------

LEDGER = """ledger AS (
  SELECT 'run' || user_id AS run_id, event_id AS seq, (event_id % 30 + 1)::INTEGER AS epoch,
         30 AS max_epochs, user_id % 3 <> 0 AS recovery, value / 1000.0::DOUBLE AS acc,
         value AS loss
  FROM events)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = F.create_map(
        F.lit("acc"), F.col("value") / F.lit(1000.0),
        F.lit("val_acc"), F.col("value") / F.lit(2000.0),
        F.lit("loss"), F.col("value"),
        F.lit("val_loss"), F.col("value") * F.lit(2.0),
    )
    return events(spark, sf_dir).select(
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") % 30 + 1).cast("int").alias("epoch"),
        F.lit(30).alias("max_epochs"),
        (F.col("user_id") % 3 != 0).alias("recovery"),
        metrics.alias("metrics"),
    )

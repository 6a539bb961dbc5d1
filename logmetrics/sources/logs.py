"""Landed log responses: a JSON header with a nested list of log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The header keys and the name of the record list.
HEADER = ["searchTime", "logCount", "is_VALID", "invalid_MSG"]
RECORDS = "logCmpList"

ENVELOPE = T.StructType(
    [
        T.StructField("searchTime", T.StringType()),
        T.StructField("logCount", T.LongType()),
        T.StructField("is_VALID", T.BooleanType()),
        T.StructField("invalid_MSG", T.StringType()),
        T.StructField("log_type", T.StringType()),
        T.StructField(
            RECORDS,
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("log_time", T.StringType()),
                        T.StructField("message", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def read_envelopes(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """One row per response file (or per line with ``multi_line=False``)."""
    return spark.read.schema(ENVELOPE).json(path, multiLine=multi_line)


def envelope_rows(envelopes: DataFrame) -> DataFrame:
    """One row per record of the list; the list decides, not the header count.

    Every other column of ``envelopes`` is kept, with the place in the list.
    """
    kept = [c for c in envelopes.columns if c != RECORDS]
    return envelopes.select(*kept, F.posexplode(RECORDS).alias("pos", "record")).select(
        *kept,
        F.col("pos").cast("long").alias("pos"),
        F.to_timestamp_ntz("record.log_time", F.lit(TIME_FORMAT)).alias("log_time"),
        F.col("record.message").alias("message"),
    )


def read_log_envelopes(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Log rows of every landed response below ``path``."""
    return envelope_rows(read_envelopes(spark, path, multi_line=multi_line))


def search_logs(
    logs: DataFrame,
    start: str,
    end: str,
    *,
    log_type: str | None = None,
    message: str | None = None,
) -> DataFrame:
    """Rows of one log type in the closed time span, optionally containing a text."""
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    found = logs.filter(F.col("log_time").between(lo, hi))
    if log_type is not None:
        found = found.filter(F.col("log_type") == log_type)
    if message:
        found = found.filter(F.contains("message", F.lit(message)))
    return found


def envelope_header(envelopes: DataFrame) -> DataFrame:
    """The header keys, and whether the declared count equals the list size."""
    missing = [c for c in HEADER if c not in envelopes.columns]
    if missing:
        raise KeyError(f"header keys missing: {missing}")
    kept = [c for c in envelopes.columns if c != RECORDS]
    listed = F.coalesce(F.size(RECORDS), F.lit(0))
    return envelopes.select(*kept, (F.col("logCount") == listed).alias("valid"))


def json_parse(df: DataFrame, body: str, schema: T.StructType | str) -> DataFrame:
    """Parse a JSON text column; the raw text stays for bodies that do not parse.

    A body that is no JSON, or does not fit the schema, keeps its text in
    ``raw``; fields that could be read from it are in ``parsed``.
    """
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    marked = T.StructType([*fields.fields, T.StructField("_broken", T.StringType())])
    text = F.when(F.trim(F.col(body)) != "", F.col(body))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    parsed = df.withColumn("parsed", F.from_json(text, marked, options))
    failed = text.isNull() | F.col("parsed").isNull() | F.col("parsed._broken").isNotNull()
    return parsed.withColumn("raw", F.when(failed, F.col(body))).withColumn(
        "parsed", F.col("parsed").dropFields("_broken")
    )


def to_json_text(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text with all its fields, null or not.

    Values with no JSON form are written as their string form.
    """
    row = F.struct(*[_plain(f) for f in df.schema.fields])
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias(name))


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """Records as JSON lines, distributed; see :func:`to_json_text`."""
    to_json_text(df).write.mode(mode).text(path)


def _plain(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    as_is = (T.NumericType, T.StringType, T.BooleanType, T.ArrayType, T.MapType, T.StructType)
    if isinstance(field.dataType, as_is):
        return column.alias(field.name)
    return column.cast("string").alias(field.name)

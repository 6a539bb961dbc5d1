"""A store of landed logs that a search reads only in part.

Files lie by date and log type, in order of time inside; a side table holds, for
every file, the hashed character triples of its messages. A search prunes by
date and type, and by a text of three letters or more it leaves out the files
that lack one of the text's triples. What is left is filtered row by row, so the
side table can only spare reading, never change the rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logmetrics.sources.logs import search_logs

#: Values a triple is hashed to, which bounds a file's entry.
HASHES = 1 << 16


def triples(text: Column) -> Column:
    """Distinct hashes of the runs of three characters; none of shorter or missing texts."""
    hashed = F.transform(
        F.sequence(F.lit(1), F.char_length(text) - 2),
        lambda at: F.pmod(F.xxhash64(F.substring(text, at, 3)), F.lit(HASHES)).cast("int"),
    )
    return F.when(F.char_length(text) > 2, F.array_distinct(hashed)).otherwise(F.array().cast("array<int>"))


def _read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _files(stored: DataFrame | None) -> DataFrame | None:
    return None if stored is None else stored.select("file").distinct()


def land_logs(logs: DataFrame, path: str) -> None:
    """Add rows (log_time, log_type, message, ...) to the store, and their files to its side table.

    Rows are range-partitioned by date, type and time, so a day that holds a
    third of all rows becomes several files. Rows without a time or type are
    kept. Files of an earlier call that broke off before its side table was
    written are taken up here.
    """
    spark = logs.sparkSession
    dated = logs.withColumn("date", F.to_date("log_time"))
    ordered = dated.repartitionByRange("date", "log_type", "log_time").sortWithinPartitions("date", "log_type", "log_time")
    ordered.write.mode("append").partitionBy("date", "log_type").parquet(f"{path}/logs")
    stored = _read(spark, f"{path}/logs")
    if stored is None:  # no rows at all
        return
    known = _files(_read(spark, f"{path}/triples"))
    every = stored.select(F.input_file_name().alias("file"), "message")
    if known is not None:
        every = every.join(F.broadcast(known), "file", "left_anti")
    each = every.select("file", F.explode_outer(triples(F.col("message"))).alias("t")).distinct()
    table = each.groupBy("file").agg(F.collect_list("t").alias("triples"))
    table.write.mode("append").parquet(f"{path}/triples")


def _day(value: str) -> Column:
    return F.to_date(F.lit(value).cast("timestamp_ntz"))


def search_store(
    spark: SparkSession,
    path: str,
    start: str,
    end: str,
    *,
    log_type: str | None = None,
    message: str | None = None,
) -> DataFrame:
    """Rows of :func:`logmetrics.sources.logs.search_logs` over the store, from the files that can hold them."""
    stored = _read(spark, f"{path}/logs")
    if stored is None:
        raise FileNotFoundError(f"no landed logs below {path}")
    # Folder names as text: a type that looks like a number stays what was written.
    fields = [T.StructField(f.name, T.StringType()) if f.name == "log_type" else f for f in stored.schema.fields]
    schema = T.StructType(fields)
    source = spark.read.schema(schema).option("basePath", f"{path}/logs")
    if message and len(message) > 2:
        wanted = F.lit(None).isNull()
        for at in range(len(message) - 2):
            wanted &= F.array_contains("triples", F.pmod(F.xxhash64(F.lit(message[at : at + 3])), F.lit(HASHES)).cast("int"))
        table = _read(spark, f"{path}/triples")
        held = [] if table is None else [r["file"] for r in table.where(~wanted).select("file").collect()]
        out = set(held)  # files not in the side table are read
        files = sorted(f for f in stored.inputFiles() if f not in out)
        if not files:
            return spark.createDataFrame([], schema).drop("date")
        stored = source.parquet(*files)
    else:
        stored = source.parquet(f"{path}/logs")
    days = stored.where(F.col("date").between(_day(start), _day(end)))
    return search_logs(days, start, end, log_type=log_type, message=message).drop("date")

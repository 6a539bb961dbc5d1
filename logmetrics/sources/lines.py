"""Training-log text as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmetrics.operators.positions import row_index


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line), 1-based, in file order.

    A text split is read in order and splits of one file are numbered by their
    start, so (file, split start, place in split) is the file order.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_place"),
    )
    numbered = row_index(raw, "_file", "_start", "_place")
    return numbered.select((F.col("idx") + 1).alias("line_no"), "line")


def split_lines(df: DataFrame, text: str, key: str) -> DataFrame:
    """Numbered lines of a text column, per row of ``df`` (whole texts)."""
    return df.select(F.col(key), F.posexplode(F.split(text, "\n", -1)).alias("n", "line")).select(
        key, (F.col("n") + 1).cast("long").alias("line_no"), "line"
    )


def context_lines(lines: DataFrame, marker: str, *, offset: int = 10) -> DataFrame:
    """The last line with ``marker`` and ``offset`` lines on each side."""
    hit = lines.filter(F.contains("line", F.lit(marker)))
    point = hit.agg(F.max("line_no").alias("p")).scalar()
    return lines.filter(F.col("line_no").between(point - offset, point + offset))

"""The pipeline's stages: (spark, docs, data folder) -> DataFrame with the columns of ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmetrics.llm.decontam import decontaminate
from logmetrics.llm.frames import col
from logmetrics.llm.neardup import drop_near_duplicates
from logmetrics.llm.pieces import encode_pieces
from logmetrics.llm.substring import dedup_substrings
from logmetrics.llm.toxicity import drop_toxic_rows, train_toxicity
from logmetrics.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the model learns from the training rows among ``docs``."""
    ship_package(spark)
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drop_toxic_rows(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    ship_package(spark)
    return drop_near_duplicates(docs).select(*map(col, docs.columns))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; texts that lose nothing stay as they are."""
    ship_package(spark)
    out = dedup_substrings(docs)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*map(col, docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not mostly benchmark passages."""
    ship_package(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids and the text they decode to."""
    ship_package(spark)
    return encode_pieces(docs)

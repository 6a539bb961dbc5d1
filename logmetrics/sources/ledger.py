"""Run ledger and model checkpoints: append-only, one row per finished epoch."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_SCHEMA = (
    "run_id string, seq bigint, epoch int, max_epochs int, recovery boolean, "
    "metrics map<string,double>"
)


def ledger_append(rows: DataFrame, path: str) -> None:
    """Add rows; earlier rows are never rewritten."""
    rows.select("run_id", "seq", "epoch", "max_epochs", "recovery", "metrics").write.mode(
        "append"
    ).parquet(path)


def ledger_entry(
    spark: SparkSession,
    run_id: str,
    seq: int,
    epoch: int,
    max_epochs: int,
    recovery: bool,
    metrics: Mapping[str, float] | None = None,
) -> DataFrame:
    row = (run_id, seq, epoch, max_epochs, recovery, dict(metrics or {}))
    return spark.createDataFrame([row], LEDGER_SCHEMA)


def ledger_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows; a ledger that is not there yet reads as empty, a damaged one is an error."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).option("ignoreCorruptFiles", False).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def latest_state(ledger: DataFrame) -> DataFrame:
    """Last row per run; the aggregate combines before the shuffle."""
    last = F.max_by(F.struct("epoch", "max_epochs", "recovery", "metrics"), "seq")
    return (
        ledger.groupBy("run_id")
        .agg(last.alias("s"), F.max("seq").alias("seq"))
        .select(
            "run_id",
            "seq",
            F.coalesce(F.try_element_at("s.metrics", F.lit("acc")), F.lit(0.0)).alias("acc"),
            F.coalesce("s.epoch", F.lit(0)).alias("epochs"),
            F.coalesce("s.max_epochs", F.lit(0)).alias("max_epochs"),
            F.coalesce("s.recovery", F.lit(False)).alias("recovery"),
        )
    )


def ledger_read(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """State of each requested run; runs without a row get the defaults."""
    return runs.select("run_id").join(latest_state(ledger), "run_id", "left").na.fill(
        {"seq": 0, "acc": 0.0, "epochs": 0, "max_epochs": 0, "recovery": False}
    )


def model_path(store: str, run_id: str, epoch: int) -> str:
    return f"{store}/run={run_id}/epoch={epoch:04d}"


def model_save(model, store: str, run_id: str, epoch: int) -> str:
    path = model_path(store, run_id, epoch)
    model.write().overwrite().save(path)
    return path


def model_load(store: str, run_id: str, epoch: int) -> MultilayerPerceptronClassificationModel:
    return MultilayerPerceptronClassificationModel.load(model_path(store, run_id, epoch))


def latest_checkpoint(ledger: DataFrame) -> DataFrame:
    """(run_id, epoch) of the newest checkpoint: the last epoch row written.

    Epochs are rewound by a resume, so newest is by write order. Rows of trained
    epochs say ``recovery`` and have a saved model; a closing row has none.
    """
    return ledger.filter((F.col("epoch") > 0) & F.col("recovery")).groupBy("run_id").agg(
        F.max_by("epoch", "seq").alias("epoch")
    )

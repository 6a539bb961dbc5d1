"""Classifier and forecaster on Spark ML, with evaluation and resumable training."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmetrics.operators.descent import Network, fit_whole
from logmetrics.operators.recovery import resume_point
from logmetrics.sources.ledger import (
    latest_checkpoint,
    ledger_append,
    ledger_entry,
    ledger_read,
    ledger_rows,
    model_load,
    model_save,
)

# Probability floor in the log loss.
SMALLEST = 1e-15


def labelled_vectors(df: DataFrame, features: str, label: str) -> DataFrame:
    vector = array_to_vector(F.col(features).cast("array<double>"))
    return df.withColumn(features, vector).withColumn(label, F.col(label).cast("double"))


def mlp_classifier(
    df: DataFrame,
    layers: Sequence[int],
    *,
    features: str = "features",
    label: str = "label",
    max_iter: int = 30,
    seed: int = 0,
    weights=None,
) -> MultilayerPerceptronClassificationModel:
    """Dense classifier with softmax output and cross-entropy loss.

    The network and its optimizer are those of Spark's perceptron: sigmoid hidden
    units, no dropout, starting weights by ``seed``, all rows in each step. The
    gradient is summed over packed rows, which are dealt out over all cores.
    """
    one = df.sparkSession.createDataFrame([([0.0] * layers[0], 0.0)], "features array<double>, label double")
    one = labelled_vectors(one, "features", "label").toDF(features, label)
    trainer = MultilayerPerceptronClassifier(
        layers=list(layers), featuresCol=features, labelCol=label, maxIter=0, seed=seed
    )
    start = trainer.fit(one).weights if weights is None else weights
    network = Network(tuple(layers), hidden="sigmoid")
    found = fit_whole(df, network, start.toArray(), max_iter, features=features, label=label)
    model = trainer.setInitialWeights(Vectors.dense(found)).fit(one)
    model.set(model.maxIter, max_iter)
    if weights is None:
        model.clear(model.initialWeights)
    else:
        model.set(model.initialWeights, weights)
    return model


def classify(df: DataFrame, model, *, features: str = "features", label: str = "label") -> DataFrame:
    """Adds prediction and probability (array) to labelled rows."""
    return (
        model.transform(labelled_vectors(df, features, label))
        .withColumn("probability", vector_to_array("probability"))
        .drop("rawPrediction")
    )


def evaluate_classifier(predicted: DataFrame, label: str = "label") -> DataFrame:
    """One row: accuracy, its percent text, mean cross-entropy."""
    hit = (F.col("prediction") == F.col(label)).cast("double")
    own = F.get("probability", F.col(label).cast("int"))
    return predicted.agg(
        F.avg(hit).alias("accuracy"),
        F.avg(-F.ln(F.greatest(own, F.lit(SMALLEST)))).alias("loss"),
    ).withColumn("percent", F.format_string("%5.2f%%", F.col("accuracy") * 100))


def evaluate_regressor(
    predicted: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row: mean squared and mean absolute error."""
    miss = F.col(prediction) - F.col(label)
    return predicted.agg(F.avg(miss * miss).alias("mse"), F.avg(F.abs(miss)).alias("mae"))


def forecast_rows(windows: DataFrame) -> DataFrame:
    """Window slices as (flat inputs, label) rows for a regressor."""
    return windows.withColumns(
        {
            "features": array_to_vector(F.flatten("inputs").cast("array<double>")),
            "label": F.col("labels")[0][0].cast("double"),
        }
    ).drop("inputs", "labels")


def window_forecaster(windows: DataFrame, *, kind: str = "linear", **options):
    """Squared-loss model from the flattened window to the next label value."""
    rows = forecast_rows(windows)
    if kind == "linear":
        return LinearRegression(**options).fit(rows)
    if kind == "gbt":
        return GBTRegressor(**options).fit(rows)
    raise ValueError(kind)


def fit_with_checkpoints(
    spark: SparkSession,
    train: DataFrame,
    validation: DataFrame,
    *,
    run_id: str,
    layers: Sequence[int],
    store: str,
    ledger: str,
    max_epochs: int = 10,
    step: int = 1,
    rate: float = 1.0,
    seed: int = 0,
    features: str = "features",
    label: str = "label",
    on_epoch: Callable[[int, dict[str, float]], None] | None = None,
) -> MultilayerPerceptronClassificationModel:
    """Train epoch by epoch; each epoch saves its weights and a ledger row.

    An interrupted run (its last row says recovery) goes on from
    int(epochs * rate) with the newest weights. A finished run gets a closing
    row with recovery = false. ``on_epoch`` runs on the driver between fits.
    """
    rows = ledger_rows(spark, ledger)
    wanted = spark.createDataFrame([(run_id,)], "run_id string")
    state = resume_point(ledger_read(rows, wanted), rate).first()
    weights, model = None, None
    if state["recovery"]:
        newest = latest_checkpoint(rows.filter(F.col("run_id") == run_id)).first()
        if newest is not None:
            model = model_load(store, run_id, newest["epoch"])
            weights = model.weights
    seq, metrics = state["seq"], {}
    train, validation = train.persist(), validation.persist()
    try:
        for epoch in range(state["resume_epoch"] + 1, max_epochs + 1):
            model = mlp_classifier(
                train, layers, features=features, label=label, max_iter=step, seed=seed,
                weights=weights,
            )
            weights = model.weights
            metrics = {}
            for prefix, part in (("", train), ("val_", validation)):
                scored = classify(part, model, features=features, label=label)
                row = evaluate_classifier(scored, label).first()
                metrics[f"{prefix}accuracy"] = row["accuracy"]
                metrics[f"{prefix}loss"] = row["loss"]
            model_save(model, store, run_id, epoch)
            seq += 1
            entry = ledger_entry(spark, run_id, seq, epoch, max_epochs, True, metrics)
            ledger_append(entry, ledger)
            if on_epoch is not None:
                on_epoch(epoch, metrics)
        done = ledger_entry(spark, run_id, seq + 1, max_epochs, max_epochs, False)
        ledger_append(done, ledger)
    finally:
        train.unpersist()
        validation.unpersist()
    return model

"""k-means: fit, inertia, elbow, assignment to given centres."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logmetrics.operators.lloyd import fit_all, stored_points


def _vectors(df: DataFrame, features: str) -> DataFrame:
    if isinstance(df.schema[features].dataType, T.ArrayType):
        return df.withColumn(features, array_to_vector(F.col(features).cast("array<double>")))
    return df


def kmeans_fit(
    df: DataFrame,
    *,
    k: int = 6,
    max_iter: int = 10_000,
    seeds: Iterable[int] = (42,),
    features: str = "features",
    tol: float = 1e-4,
) -> KMeansModel:
    """Best of several seeded starts, by training cost."""
    data = _vectors(df, features).select(features).persist()
    try:
        fits = [
            KMeans(k=k, maxIter=max_iter, seed=s, tol=tol, featuresCol=features,
                   predictionCol="cluster_label").fit(data)
            for s in seeds
        ]
    finally:
        data.unpersist()
    return min(fits, key=lambda m: m.summary.trainingCost)


def attach_labels(df: DataFrame, model: KMeansModel) -> DataFrame:
    """Cluster label as a column; no join."""
    return model.transform(_vectors(df, model.getFeaturesCol()))


def kmeans_fit_predict(df: DataFrame, **options) -> DataFrame:
    return attach_labels(df, kmeans_fit(df, **options))


def sort_by_cluster(df: DataFrame, *tiebreak: str) -> DataFrame:
    return df.orderBy("cluster_label", *tiebreak)


def kmeans_inertia(model: KMeansModel) -> float:
    """Sum of squared distances to the nearest centre."""
    return model.summary.trainingCost


def total_inertia(df: DataFrame, features: str = "features") -> DataFrame:
    """Inertia for one cluster in closed form: per-dimension sum of (x - mean)^2.

    One pass: sample variance per dimension times n - 1.
    """
    spread = _vectors(df, features).agg(
        vector_to_array(Summarizer.variance(F.col(features))).alias("variance"),
        F.count(F.lit(1)).alias("n"),
    )
    total = F.aggregate("variance", F.lit(0.0), lambda acc, v: acc + v)
    return spread.select((total * (F.col("n") - 1)).alias("inertia"))


def elbow(
    df: DataFrame,
    *,
    ks: Iterable[int] = (1, 2, 3, 4),
    max_iter: int = 300,
    starts: int = 10,
    seed: int = 0,
    features: str = "features",
    key: str | None = None,
) -> DataFrame:
    """(k, inertia), best of ``starts`` per k; every k and start in the same scans.

    k = 1 has a closed form. ``key`` names a unique column that makes the seeds
    independent of the row's place; vectors that are null take no part, and
    without vectors the inertia is null.
    """
    ks = list(ks)
    points = stored_points(df, features, key)
    if points.isEmpty():
        return df.sparkSession.createDataFrame([(k, None) for k in ks], "k bigint, inertia double")
    best = fit_all(points, [k for k in ks if k > 1], starts, seed, max_iter)
    rows = [
        (k, float(best[k].inertia if k > 1 else total_inertia(points, "x").first()["inertia"]))
        for k in ks
    ]
    return df.sparkSession.createDataFrame(rows, "k bigint, inertia double")


def kmeans_assign(
    df: DataFrame, centres: list[tuple[int, list[float]]], features: str = "features"
) -> DataFrame:
    """Nearest of the given centres, ties to the lowest id; null for a missing vector.

    The centres are a list in the caller's program; they travel as one matrix
    and no row moves.
    """
    order = sorted(centres)
    held = df.sparkSession.sparkContext.broadcast(
        (np.array([c for c, _ in order], np.int64), np.array([v for _, v in order], float))
    )
    df = df.drop("cluster_label", "distance")
    at = df.columns.index(features)
    schema = T.StructType(
        [*df.schema.fields, T.StructField("cluster_label", T.LongType()), T.StructField("distance", T.DoubleType())]
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, matrix = held.value
        for batch in batches:
            vectors = batch.column(at)
            known = vectors.is_valid().to_numpy(zero_copy_only=False)
            x = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, matrix.shape[1])
            best, found = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
            for label, centre in zip(labels, matrix, strict=True):  # the smaller id first
                distance = np.square(x - centre).sum(axis=1)
                closer = distance < best
                best[closer], found[closer] = distance[closer], label
            out = [np.zeros(len(known), np.int64), np.zeros(len(known))]
            for to, values in zip(out, (found, best), strict=True):
                to[known] = values
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(v, mask=~known) for v in out)],
                [*batch.schema.names, "cluster_label", "distance"],
            )

    return df.mapInArrow(assign, schema)

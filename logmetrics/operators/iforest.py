"""Isolation forest: fit on small samples, score every row, cut by contamination.

Method: Liu, Ting, Zhou (2008), "Isolation forest".
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmetrics.operators.forest import sample_trees
from logmetrics.operators.selection import row_at
from logmetrics.operators.treescore import (
    by_tree,
    fold_trees,
    pack_trees,
    plain_tree,
    vectors_of,
)
from logmetrics.operators.trees import isolation_depths, isolation_tree, mean_path
from logmetrics.session import materialize

NODE_SCHEMA = (
    "tree bigint, node int, parent int, left int, right int, dim int, cut double, n bigint"
)


def iforest_fit(
    points: DataFrame,
    key: str,
    *,
    features: str = "features",
    num_trees: int = 200,
    sample_size: int = 256,
    seed: int = 0,
) -> DataFrame:
    """Node table; each tree sees min(sample_size, n) points drawn without replacement."""
    sample = sample_trees(points, key, num_trees=num_trees, tree_size=sample_size, seed=seed)

    def build(table: pa.Table) -> pa.Table:
        tree = table["tree"][0].as_py()
        rng = np.random.default_rng([seed, tree])
        return isolation_tree(vectors_of(table[features]), rng).to_arrow(tree)

    return by_tree(sample.select("tree", features), num_trees).applyInArrow(build, NODE_SCHEMA)


def iforest_score(
    points: DataFrame, nodes: DataFrame, *, features: str = "features", name: str = "score"
) -> DataFrame:
    """2 ^ (-mean path / c(sample size)) for every row; larger is odder."""
    nodes = nodes if hasattr(nodes, "_stored_path") else materialize(nodes, "nodes")  # read twice
    packed = pack_trees(nodes, plain_tree)
    depths = fold_trees(points, packed, features=features, name=name, score=isolation_depths)
    root = nodes.filter(F.col("node") == 0).agg(F.max("n").alias("n")).first()["n"] or 0
    unit = float(mean_path(np.array([root]))[0])
    if unit == 0.0:
        # One-point samples: every path is 0, the score is 1 as for equal lengths.
        return depths.withColumn(name, F.when(F.col(name).isNotNull(), F.lit(1.0)))
    return depths.withColumn(name, F.pow(F.lit(2.0), -F.col(name) / F.lit(unit)))


def iforest_threshold(
    scores: DataFrame, contamination: float, *tiebreak: str, score: str = "score"
) -> DataFrame:
    """One row: the (1 - contamination) quantile of the scores, interpolated; null without scores.

    Exact at any size: the two scores around the quantile are found by counting
    (see :func:`logmetrics.operators.selection.row_at`), with no sorted copy.
    Equal scores need no order, so ``tiebreak`` is not looked at.
    """
    scores = scores.select(score)
    at = max(scores.count() - 1, 0) * (1.0 - contamination)
    below, above = math.floor(at), math.ceil(at)
    picked = row_at(scores, below, score)
    if above > below:
        picked = picked.unionAll(row_at(scores, above, score))
    return picked.agg(
        (F.min(score) + (F.max(score) - F.min(score)) * F.lit(at - below)).alias("threshold")
    )


def iforest_outliers(
    scores: DataFrame, contamination: float, *tiebreak: str, score: str = "score"
) -> DataFrame:
    """Rows with a flag: 1 above the threshold, else 0."""
    cut = iforest_threshold(scores, contamination, *tiebreak, score=score).scalar()
    return scores.withColumn("outlier", F.when(F.col(score) > cut, 1).otherwise(0))

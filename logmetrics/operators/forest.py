"""Random cut forests over feature vectors.

Method: Guha, Mishra, Roy, Schrijvers (2016), "Robust random cut forest based
anomaly detection on streams". Spark draws the samples, groups them by tree and
averages the scores; a task sees one tree's points (at most ``tree_size``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmetrics.operators.features import minmax_normalize
from logmetrics.operators.positions import round_hash, shuffled_index
from logmetrics.operators.treescore import (
    PackedTrees,
    by_tree,
    fold_trees,
    leaf_points,
    pack_trees,
    vectors_of,
)
from logmetrics.operators.trees import cut_tree, displacements, insertion_scores
from logmetrics.session import materialize

NODE_SCHEMA = (
    "tree bigint, node int, parent int, left int, right int, "
    "dim int, cut double, n bigint, point array<double>"
)


@dataclass(frozen=True)
class ForestShape:
    """How many rounds, trees per round and points per tree for ``n`` points.

    Each round cuts a permutation of all points into n // size disjoint groups;
    rounds repeat until there are at least ``num_trees`` trees. Fewer points
    than ``tree_size`` give trees of all points.
    """

    n: int
    size: int
    per_round: int
    rounds: int

    @property
    def trees(self) -> int:
        return self.per_round * self.rounds

    @classmethod
    def of(cls, n: int, num_trees: int, tree_size: int) -> ForestShape:
        if n == 0:
            return cls(0, 0, 0, 0)
        size = min(tree_size, n)
        per_round = n // size
        return cls(n, size, per_round, math.ceil(num_trees / per_round))


def forest_sample(
    points: DataFrame,
    key: str,
    *,
    num_trees: int,
    tree_size: int,
    seed: int = 0,
    n: int | None = None,
) -> DataFrame:
    """Rows of ``points`` with the tree that holds them; every round covers all
    points but the remainder of n / tree_size."""
    total = points.count() if n is None else n
    shape = ForestShape.of(total, num_trees, tree_size)
    if shape.n == 0:
        return points.limit(0).withColumn("tree", F.lit(0).cast("long"))
    placed = shuffled_index(points, key, seed=seed, n=shape.n, rounds=shape.rounds)
    return (
        placed.filter(F.col("pos") < shape.per_round * shape.size)
        .withColumn(
            "tree",
            F.col("round") * shape.per_round + F.expr(f"pos div {shape.size}"),
        )
        .drop("round", "pos")
    )


def sample_trees(
    points: DataFrame,
    key: str,
    *,
    num_trees: int,
    tree_size: int,
    seed: int = 0,
    n: int | None = None,
) -> DataFrame:
    """The first ``num_trees`` trees of :func:`forest_sample` and no others.

    A model needs only num_trees * tree_size points. Where one round holds them
    all, rows whose hash is clearly too late in the order are filtered in the
    scan; the count is checked and the cut widened if too few came through, so
    the result equals the full order's.
    """
    total = points.count() if n is None else n
    shape = ForestShape.of(total, num_trees, tree_size)
    kept, kept_n = points, total
    needed = num_trees * shape.size
    if shape.rounds == 1 and needed * 4 < total:
        share = (needed + 8 * math.sqrt(needed) + 64) / total
        early = round_hash(seed, F.lit(0), F.col(key))
        while share < 1:
            # About ``needed`` rows, written once: one scan finds, counts and keeps them.
            cut = F.lit(format(int(share * 16**12), "012x"))
            kept = materialize(points.filter(early < cut), "early")
            kept_n = kept.count()
            if kept_n >= needed:
                break
            share *= 2
        else:
            kept, kept_n = points, total
    return forest_sample(
        kept, key, num_trees=num_trees, tree_size=tree_size, seed=seed, n=kept_n
    ).filter(F.col("tree") < num_trees)


def rcf_build(sample: DataFrame, *, features: str = "features", seed: int = 0,
              trees: int | None = None) -> DataFrame:
    """Random cut trees as a node table, one tree per group.

    The cut dimension is drawn in proportion to its range, the cut uniformly in
    the range; equal points share a leaf with a count. Draws depend on (seed,
    tree) only, so lost and repeated tasks give the same tree.
    """

    def build(table: pa.Table) -> pa.Table:
        tree = table["tree"][0].as_py()
        grown = cut_tree(vectors_of(table[features]), np.random.default_rng([seed, tree]))
        return grown.to_arrow(tree)

    return by_tree(sample.select("tree", features), trees).applyInArrow(build, NODE_SCHEMA)


def codisp(
    sample: DataFrame,
    key: str,
    *,
    features: str = "features",
    seed: int = 0,
    trees: int | None = None,
) -> DataFrame:
    """(tree, key, codisp) for the points of each tree.

    Collusive displacement: the largest ratio, over the branches above the
    point's leaf and the leaf itself, of points under the sibling branch to
    points under the own branch.
    """
    chosen = sample.select("tree", key, features)

    def score(table: pa.Table) -> pa.Table:
        tree = table["tree"][0].as_py()
        grown = cut_tree(vectors_of(table[features]), np.random.default_rng([seed, tree]))
        return pa.table(
            {"tree": table["tree"], key: table[key], "codisp": displacements(grown)}
        )

    schema = chosen.select("tree", key).schema.add("codisp", "double")
    return by_tree(chosen, trees).applyInArrow(score, schema)


def mean_score_per_point(
    scores: DataFrame, points: DataFrame, key: str, *, score: str = "codisp", name: str = "score"
) -> DataFrame:
    """Average over the trees that hold a point; points in no tree get null."""
    means = scores.groupBy(key).agg(F.avg(score).alias(name))
    return points.select(key).join(means, key, "left")


def rcf_score(
    points: DataFrame,
    key: str,
    *,
    features: str = "features",
    num_trees: int = 100,
    tree_size: int = 256,
    seed: int = 0,
    normalize: bool = True,
    stored: bool = False,
) -> DataFrame:
    """Average collusive displacement per point, by default scaled to 0..1.

    The points are read three times (size, order, trees), so they are written
    once first unless the caller says they are ``stored`` already.
    """
    stored = points if stored else materialize(points.select(key, features), "points")
    n = stored.count()
    shape = ForestShape.of(n, num_trees, tree_size)
    sample = forest_sample(
        stored, key, num_trees=num_trees, tree_size=tree_size, seed=seed, n=n
    )
    scores = codisp(sample, key, features=features, seed=seed, trees=shape.trees)
    means = mean_score_per_point(scores, stored, key)
    # Written once: the bounds and the scaled rows both read it.
    return minmax_normalize(materialize(means, "scores"), ["score"]) if normalize else means


def rcf_fit(
    points: DataFrame,
    key: str,
    *,
    features: str = "features",
    num_trees: int = 50,
    tree_size: int = 512,
    seed: int = 0,
) -> DataFrame:
    """A forest to keep: node table of ``num_trees`` trees (write it to parquet)."""
    sample = sample_trees(points, key, num_trees=num_trees, tree_size=tree_size, seed=seed)
    return rcf_build(sample, features=features, seed=seed, trees=num_trees)


def rcf_pack(nodes: DataFrame) -> PackedTrees:
    """A stored forest ready to score batch after batch."""
    return pack_trees(nodes, leaf_points)


def rcf_score_against(
    points: DataFrame,
    forest: DataFrame | PackedTrees,
    *,
    features: str = "features",
    name: str = "score",
) -> DataFrame:
    """Score points that are not in the stored forest.

    Per tree the expected collusive displacement if the point were inserted:
    at each branch on its way it splits off with the share of the box's growth
    in the grown box's size. An expectation needs no draws, so a repeated task
    gives the same score.
    """
    packed = forest if isinstance(forest, PackedTrees) else rcf_pack(forest)
    return fold_trees(points, packed, features=features, name=name, score=insertion_scores)

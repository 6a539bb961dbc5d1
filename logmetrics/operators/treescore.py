"""Spark side shared by the two forests: grouping by tree, scoring by broadcast."""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmetrics.operators.trees import Tree
from logmetrics.session import materialize

# A broadcast of stored trees stays below this; larger forests stay on the cluster.
BROADCAST_BYTES = 128 * 1024 * 1024


def vectors_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as a matrix; every vector must be there, whole and equally long."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(whole):
        return np.empty((0, 0))
    values = whole.flatten()
    lengths = pc.min_max(pc.list_value_length(whole)).as_py()
    if whole.null_count or values.null_count or lengths["min"] != lengths["max"]:
        raise ValueError("feature vectors must not be null, hold nulls or differ in length")
    flat = values.to_numpy(zero_copy_only=False)
    return flat.reshape(len(whole), -1).astype(np.float64, copy=False)


def by_tree(sample: DataFrame, trees: int | None):
    """Group by tree over enough partitions.

    Trees are small in bytes but costly to grow, so the partition count follows
    the number of trees and not the data size.
    """
    if trees is None:
        trees = sample.select("tree").distinct().count()
    cores = sample.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(trees, 4 * cores), math.ceil(trees / 512))
    return sample.repartition(parts, "tree").groupBy("tree")


def leaf_points(rows: list) -> Tree:
    """A stored cut tree back in arrays."""
    tree = plain_tree(rows)
    width = next(len(r["point"]) for r in rows if r["point"] is not None)
    tree.points = np.full((len(rows), width), np.nan)
    for r in rows:
        if r["point"] is not None:
            tree.points[r["node"]] = r["point"]
    return tree


def plain_tree(rows: list) -> Tree:
    rows.sort(key=lambda r: r["node"])
    ints = [
        np.array([r[c] for r in rows], dtype=np.int32) for c in ("parent", "left", "right", "dim")
    ]
    cut = np.array([0.0 if r["cut"] is None else r["cut"] for r in rows])
    return Tree(*ints, cut, np.array([r["n"] for r in rows], dtype=np.int64))


def tree_bytes(tree: Tree) -> bytes:
    """A tree's arrays as one record."""
    sink = io.BytesIO()
    np.savez(sink, **{k: v for k, v in vars(tree).items() if v is not None})
    return sink.getvalue()


def tree_of(data: bytes) -> Tree:
    with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
        return Tree(**{k: arrays[k] for k in arrays.files})


@dataclass(frozen=True)
class PackedTrees:
    """Stored trees, one record each, and a broadcast of them where they measure small."""

    blocks: DataFrame
    count: int
    groups: int
    held: object | None


def pack_trees(nodes: DataFrame, load: Callable[[list], Tree], limit: int | None = None) -> PackedTrees:
    """Pack a node table, read once, into one record per tree, on the executors.

    Records that together measure up to ``limit`` bytes are broadcast as they
    are; more of them stay where they lie, in groups below that size, and meet
    the points there (see :func:`fold_trees`). Nodes never pass the driver.
    """
    limit = BROADCAST_BYTES if limit is None else limit

    def pack(table: pa.Table) -> pa.Table:
        tree = tree_bytes(load(table.to_pylist()))
        return pa.table({"tree": table["tree"][:1], "payload": pa.array([tree], pa.binary())})

    packed = by_tree(nodes, 512)  # enough partitions for many trees, without a pass to count them
    blocks = materialize(packed.applyInArrow(pack, "tree bigint, payload binary"), "trees")
    size = F.octet_length("payload")
    row = blocks.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.max(size).alias("most")).first()
    if (row["bytes"] or 0) <= limit:
        held = [bytes(r["payload"]) for r in blocks.orderBy("tree").select("payload").collect()]
        return PackedTrees(blocks, row["n"], 1, blocks.sparkSession.sparkContext.broadcast(held))
    # Groups dealt by hash are uneven; half the size leaves room for that.
    return PackedTrees(blocks, row["n"], min(row["n"], -(-2 * row["bytes"] // max(limit, row["most"]))), None)


def fold_trees(
    points: DataFrame,
    trees: PackedTrees,
    *,
    features: str,
    name: str,
    score: Callable[[Tree, np.ndarray], np.ndarray],
    point_rows: int = 50_000,
) -> DataFrame:
    """Mean of ``score`` over all packed trees, added to ``points``.

    Broadcast trees meet the points where these are. Else each block of about
    ``point_rows`` points meets each group of trees in a task of its own, and a
    point's partial sums are added up; the sums are slim rows.
    """
    if not trees.count:
        return points.withColumn(name, F.lit(None).cast("double"))
    if trees.held is not None:
        scored = _add_scores(points.withColumn(name, F.lit(0.0)), trees.held, features, name, score)
        return scored.withColumn(name, F.col(name) / F.lit(float(trees.count)))
    stored = materialize(points.withColumn("_row", F.monotonically_increasing_id()), "points")
    parts = max(1, -(-stored.count() // point_rows))
    part = F.pmod(F.xxhash64("_row"), F.lit(parts)).alias("_part")
    group = F.explode(F.sequence(F.lit(0), F.lit(trees.groups - 1))).alias("_group")
    left = stored.select("_row", F.col(features).alias("_x"), part).select("*", group)
    each = F.pmod(F.xxhash64("tree"), F.lit(trees.groups)).cast("int").alias("_group")
    right = trees.blocks.select("tree", "payload", each).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("_part")
    )

    def partial(own: pa.Table, met: pa.Table) -> pa.Table:
        matrix, total = vectors_of(own["_x"]), np.zeros(own.num_rows)
        for data in met.sort_by("tree")["payload"].to_pylist() if own.num_rows else []:
            total += score(tree_of(data), matrix)
        return pa.table({"_row": own["_row"], "_sum": pa.array(total)})

    sums = left.groupBy("_part", "_group").cogroup(right.groupBy("_part", "_group")).applyInArrow(
        partial, "_row bigint, _sum double"
    )
    means = sums.groupBy("_row").agg((F.sum("_sum") / F.lit(float(trees.count))).alias(name))
    return stored.drop(name).join(means, "_row").drop("_row")


def _add_scores(points, shared, features, name, score) -> DataFrame:
    place = points.columns.index(name)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        trees = None
        for batch in batches:
            matrix = vectors_of(batch.column(features))
            total = batch.column(name).to_numpy(zero_copy_only=False).copy()
            if len(total):
                trees = trees or [tree_of(data) for data in shared.value]
                for tree in trees:
                    total += score(tree, matrix)
            yield batch.set_column(place, name, pa.array(total))

    return points.mapInArrow(add, points.schema)

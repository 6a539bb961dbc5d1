import hashlib
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logmetrics.operators import forest as rf
from logmetrics.operators import iforest as ifo
from logmetrics.operators import trees as tr
from logmetrics.operators import treescore
from logmetrics.operators.trees import insertion_scores


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    x[7] = [25.0, -25.0, 25.0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, features array<double>")


def two_valued(spark, ones, zeros):
    rows = [(k, [1.0 if k < ones else 0.0]) for k in range(ones + zeros)]
    return spark.createDataFrame(rows, "id long, features array<double>")


# --- one tree ---------------------------------------------------------------


def members(tree, node):
    """Input rows below a node, walked from the leaves up."""
    found = []
    for row, at in enumerate(tree.leaf):
        while at >= 0:
            if at == node:
                found.append(row)
                break
            at = tree.parent[at]
    return found


def brute_displacement(tree, row):
    best, at = 0.0, tree.leaf[row]
    while tree.parent[at] >= 0:
        above = tree.parent[at]
        other = tree.left[above] + tree.right[above] - at
        best = max(best, len(members(tree, other)) / len(members(tree, at)))
        at = above
    return best


def test_cut_tree_and_displacement_by_brute_force():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(40, 2)), 1)
    x[30:] = x[0]
    tree = tr.cut_tree(x, np.random.default_rng(0))
    for node in range(len(tree.n)):
        below = members(tree, node)
        assert tree.n[node] == len(below)
        if tree.left[node] >= 0:
            low = x[members(tree, tree.left[node]), tree.dim[node]]
            high = x[members(tree, tree.right[node]), tree.dim[node]]
            assert low.max() <= tree.cut[node] < high.min()
        else:
            assert len(np.unique(x[below], axis=0)) == 1
    got = tr.displacements(tree)
    assert got.tolist() == [brute_displacement(tree, r) for r in range(40)]


def test_cut_tree_does_not_depend_on_row_order():
    x = np.random.default_rng(2).normal(size=(50, 4))
    order = np.random.default_rng(3).permutation(50)
    a = tr.displacements(tr.cut_tree(x, np.random.default_rng(9)))
    b = tr.displacements(tr.cut_tree(x[order], np.random.default_rng(9)))
    assert np.array_equal(a[order], b)


def test_equal_points_have_no_displacement():
    assert tr.displacements(tr.cut_tree(np.ones((9, 2)), np.random.default_rng(0))).tolist() == [0] * 9


def simulate_insert(tree, point, low, high, rng):
    """Insert by random cuts of the grown box; the displacement that results."""
    best, node = 0.0, 0
    while True:
        lo, hi = np.minimum(low[node], point), np.maximum(high[node], point)
        edges = np.cumsum(hi - lo)
        if edges[-1] > 0:
            draw = rng.random() * edges[-1]
            dim = int(np.searchsorted(edges, draw, side="right"))
            cut = lo[dim] + draw - (edges[dim] - (hi - lo)[dim])
            if cut < low[node][dim] or cut >= high[node][dim]:
                return max(best, float(tree.n[node]))
        if tree.left[node] < 0:
            return best
        go_left = point[tree.dim[node]] <= tree.cut[node]
        nxt = tree.left[node] if go_left else tree.right[node]
        other = tree.right[node] if go_left else tree.left[node]
        best = max(best, tree.n[other] / (tree.n[nxt] + 1))
        node = nxt


def test_insertion_score_is_the_mean_of_random_insertions():
    rng = np.random.default_rng(4)
    tree = tr.cut_tree(rng.normal(size=(30, 2)), np.random.default_rng(0))
    low, high = tr._boxes(tree)
    for point in (np.array([0.1, 0.2]), np.array([3.0, -1.0])):
        expected = tr.insertion_scores(tree, point[None, :])[0]
        drawn = [simulate_insert(tree, point, low, high, rng) for _ in range(4000)]
        spread = np.std(drawn) / np.sqrt(len(drawn))
        assert abs(np.mean(drawn) - expected) < 5 * spread + 1e-9


def test_isolation_depths_by_walking():
    x = np.random.default_rng(6).normal(size=(64, 3))
    tree = tr.isolation_tree(x, np.random.default_rng(1))
    got = tr.isolation_depths(tree, x)
    for row, point in enumerate(x):
        node, depth = 0, 0
        while tree.left[node] >= 0:
            node = tree.left[node] if point[tree.dim[node]] <= tree.cut[node] else tree.right[node]
            depth += 1
        assert depth <= 6
        assert got[row] == depth + tr.mean_path(np.array([tree.n[node]]))[0]


def test_mean_path():
    got = tr.mean_path(np.array([0, 1, 2, 3, 256]))
    assert got[:3].tolist() == [0, 0, 1]
    assert got[3] == pytest.approx(2 * (np.log(2) + np.euler_gamma) - 4 / 3)
    assert got[4] == pytest.approx(10.244770920)


# --- sampling ---------------------------------------------------------------


@pytest.mark.parametrize(
    ("n", "trees", "size", "want"),
    [(1000, 3, 300, (300, 3, 1)), (100, 7, 40, (40, 2, 4)), (10, 4, 256, (10, 1, 4)), (0, 5, 9, (0, 0, 0))],
)
def test_forest_shape(n, trees, size, want):
    shape = rf.ForestShape.of(n, trees, size)
    assert (shape.size, shape.per_round, shape.rounds) == want


def test_sample_is_disjoint_per_round_and_repeatable(cloud):
    def draw(parts):
        rows = rf.forest_sample(cloud.repartition(parts), "id", num_trees=5, tree_size=128, seed=3)
        return sorted((r["tree"], r["id"]) for r in rows.select("tree", "id").collect())

    got = draw(1)
    assert got == draw(7)
    assert {t for t, _ in got} == set(range(6))  # two per round, three rounds
    for round_ in range(3):
        ids = [i for t, i in got if t // 2 == round_]
        assert len(ids) == len(set(ids)) == 256


def test_fewer_points_than_a_tree(cloud):
    few = cloud.filter("id < 20")
    scores = rf.rcf_score(few, "id", num_trees=4, tree_size=256).collect()
    assert len(scores) == 20 and all(r["score"] is not None for r in scores)


def test_no_points(cloud):
    assert rf.forest_sample(cloud.limit(0), "id", num_trees=3, tree_size=9).count() == 0


def test_sample_trees_cut_equals_the_full_order(spark):
    points = spark.range(20_000).withColumnRenamed("id", "k")
    few = rf.sample_trees(points, "k", num_trees=4, tree_size=50, seed=8).collect()
    order = sorted(range(20_000), key=lambda i: hashlib.md5(f"8:0:{i}".encode()).hexdigest())
    assert {r["k"]: r["tree"] for r in few} == {i: p // 50 for p, i in enumerate(order[:200])}


# --- forests ----------------------------------------------------------------


def test_two_values_give_the_ratio(spark):
    points = two_valued(spark, 3, 17)
    got = {r["id"]: r["score"] for r in
           rf.rcf_score(points, "id", num_trees=5, tree_size=20, normalize=False).collect()}
    assert all(got[k] == pytest.approx(17 / 3 if k < 3 else 3 / 17) for k in range(20))


def test_unsampled_points_have_no_score(spark, cloud):
    sample = rf.forest_sample(cloud, "id", num_trees=1, tree_size=256, seed=1)
    scores = rf.mean_score_per_point(rf.codisp(sample, "id"), cloud, "id")
    assert scores.filter("score is null").count() == 300 - 256


def test_outlier_scores_highest_in_both_forests(cloud):
    rcf = rf.rcf_score(cloud, "id", num_trees=30, tree_size=100)
    assert rcf.orderBy(F.desc("score")).first()["id"] == 7
    bounds = rcf.agg(F.min("score"), F.max("score")).first()
    assert tuple(bounds) == (0.0, 1.0)
    nodes = ifo.iforest_fit(cloud, "id", num_trees=50, sample_size=64)
    assert ifo.iforest_score(cloud, nodes).orderBy(F.desc("score")).first()["id"] == 7


def test_scores_do_not_depend_on_partitions(cloud):
    def scores(parts):
        out = rf.rcf_score(cloud.repartition(parts), "id", num_trees=6, tree_size=100, seed=2)
        return {r["id"]: pytest.approx(r["score"]) for r in out.collect()}

    assert scores(1) == scores(9)


def test_stored_forest_scores_new_points(cloud, monkeypatch, tmp_path):
    path = str(tmp_path / "forest")
    rf.rcf_fit(cloud, "id", num_trees=8, tree_size=64).write.parquet(path)
    nodes = cloud.sparkSession.read.parquet(path)
    assert nodes.groupBy("tree").agg(F.max("n").alias("n")).filter("n = 64").count() == 8
    one = {r["id"]: r["score"] for r in rf.rcf_score_against(cloud, nodes).collect()}
    assert max(one, key=one.get) == 7
    monkeypatch.setattr(treescore, "BROADCAST_BYTES", 20_000)  # trees and points meet in blocks
    packed = rf.rcf_pack(nodes)
    assert packed.held is None and packed.groups > 1
    blocked = treescore.fold_trees(
        cloud.withColumn("score", F.lit("old")), packed, features="features", name="score",
        score=insertion_scores, point_rows=37,
    )
    many = {r["id"]: r["score"] for r in blocked.collect()}
    assert many.keys() == one.keys() and all(many[k] == pytest.approx(v) for k, v in one.items())


def test_a_fit_runs_once_when_its_trees_are_packed(cloud):
    grown = cloud.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            grown.add(batch.num_rows)
            yield batch

    fit = rf.rcf_fit(cloud, "id", num_trees=5, tree_size=32)
    nodes = fit.mapInArrow(count, fit.schema)
    packed = rf.rcf_pack(nodes)
    total = grown.value
    assert packed.count == 5 and total > 5 * 32
    assert rf.rcf_score_against(cloud, packed).count() == rf.rcf_score_against(cloud, packed).count()
    assert grown.value == total


def test_vectors_must_be_whole(spark):
    for bad in ([None], [[1.0, None]], [[1.0], [1.0, 2.0]]):
        with pytest.raises(ValueError):
            treescore.vectors_of(pa.array(bad, type=pa.list_(pa.float64())))
    sliced = pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]).slice(1)
    assert treescore.vectors_of(sliced).tolist() == [[3.0, 4.0], [5.0, 6.0]]


def test_constant_sample_scores_one_half(spark):
    points = spark.createDataFrame([(k, [4.0, 4.0]) for k in range(50)], "id long, features array<double>")
    scores = ifo.iforest_score(points, ifo.iforest_fit(points, "id", num_trees=3)).collect()
    assert all(r["score"] == pytest.approx(0.5) for r in scores)


@pytest.mark.parametrize("share", [0.0, 0.05, 0.1, 0.33, 1.0])
def test_threshold_is_the_interpolated_quantile(spark, share):
    values = np.random.default_rng(0).random(101).round(2)
    scores = spark.createDataFrame(list(enumerate(values.tolist())), "id long, score double")
    cut = ifo.iforest_threshold(scores, share, "id").first()["threshold"]
    assert cut == pytest.approx(np.percentile(values, 100 * (1 - share)))
    flagged = ifo.iforest_outliers(scores, share, "id").filter("outlier = 1").count()
    assert abs(flagged - (values > cut + 1e-12).sum()) <= 1


def walked_depths(tree, points):
    """Row lists that shrink as rows reach their leaves."""
    at, depth = np.zeros(len(points), dtype=np.int64), np.zeros(len(points))
    moving = np.flatnonzero(tree.left[at] >= 0)
    while len(moving):
        node = at[moving]
        low = points[moving, tree.dim[node]] <= tree.cut[node]
        at[moving] = np.where(low, tree.left[node], tree.right[node])
        depth[moving] += 1
        moving = moving[tree.left[at[moving]] >= 0]
    return depth + tr.mean_path(tree.n)[at]


def test_isolation_depths_in_fewer_steps_over_the_rows():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(20_000, 48))
    points[::7, ::5] = np.nan
    grown = [tr.isolation_tree(np.nan_to_num(points[k : k + 256]), rng) for k in (0, 256, 512)]
    grown.append(tr.isolation_tree(np.ones((5, 48)), rng))

    def seconds(depths):
        began = time.process_time()
        found = [depths(tree, points) for tree in grown]
        return time.process_time() - began, found

    (slow, expected), (fast, got) = (min((seconds(f) for _ in range(5)), key=lambda r: r[0]) for f in (walked_depths, tr.isolation_depths))
    assert all((a == b).all() for a, b in zip(expected, got, strict=True))
    assert fast < 0.8 * slow

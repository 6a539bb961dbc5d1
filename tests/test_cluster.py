import numpy as np
import pytest

from logmetrics.operators import cluster as k
from logmetrics.session import spread


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    points = [(g * 20 + j, (rng.normal(size=3) + 40 * g).tolist()) for g in range(3) for j in range(20)]
    return spark.createDataFrame(points, "id long, features array<double>")


def test_kmeans_finds_separate_blobs(blobs):
    model = k.kmeans_fit(blobs, k=3, seeds=range(4))
    labels = {r["id"]: r["cluster_label"] for r in k.attach_labels(blobs, model).collect()}
    groups = [{labels[g * 20 + j] for j in range(20)} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    ordered = k.sort_by_cluster(k.attach_labels(blobs, model), "id").collect()
    keys = [(r["cluster_label"], r["id"]) for r in ordered]
    assert keys == sorted(keys)
    assert k.kmeans_inertia(model) < 3 * 20 * 10


def test_total_inertia_closed_form(blobs):
    x = np.array([r["features"] for r in blobs.collect()])
    want = ((x - x.mean(axis=0)) ** 2).sum()
    assert k.total_inertia(blobs).first()["inertia"] == pytest.approx(want)


def test_elbow_never_rises(blobs):
    costs = [r["inertia"] for r in k.elbow(blobs, starts=4).orderBy("k").collect()]
    assert len(costs) == 4 and costs == sorted(costs, reverse=True)


def test_assign_ties_go_to_the_lowest_id(spark):
    points = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 0.0])], "id int, features array<double>")
    out = k.kmeans_assign(points, [(7, [1.0, 0.0]), (2, [-1.0, 0.0])])
    got = {r["id"]: (r["cluster_label"], r["distance"]) for r in out.collect()}
    assert got == {0: (2, 1.0), 1: (7, 4.0)}


def test_points_are_spread_by_rows(spark, tmp_path):
    """A task's share of a plain scan does not grow with the table."""
    path = str(tmp_path / "points")
    spark.range(1000).coalesce(1).write.parquet(path)
    scan = spark.read.parquet(path)
    assert spread(scan, "id", rows=50).rdd.getNumPartitions() == 20
    assert spread(scan, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism

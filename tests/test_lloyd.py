import numpy as np
import pytest
from pyspark.sql import functions as F

from logmetrics.operators import lloyd as ll
from logmetrics.operators.cluster import elbow, kmeans_assign


def brute(x, centres, max_iter=300):
    centres, before = centres.copy(), np.inf
    for _ in range(max_iter):
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        labels, cost = d.argmin(axis=1), d.min(axis=1).sum()
        means = np.array([x[labels == c].mean(axis=0) if (labels == c).any() else centres[c] for c in range(len(centres))])
        if not cost < before - 1e-12 or np.allclose(means, centres, atol=0, rtol=0):
            return cost
        centres, before = means, cost
    return cost


@pytest.fixture(scope="module")
def x():
    draw = np.random.default_rng(1)
    return np.concatenate([draw.normal(c, 1.0, (70, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 5, 5))])


@pytest.fixture(scope="module")
def points(spark, x):
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, features array<double>")
    return ll.stored_points(df.repartition(3), key="id")


def test_concurrent_fits_are_separate_fits(points, x, monkeypatch):
    monkeypatch.setattr(ll, "ROWS", 16)
    ks, seeds = [2, 2, 3, 4, 4], [0, 1, 0, 0, 1]
    starts = ll.seed_centres(points, ks, seeds)
    assert [len(s) for s in starts] == ks
    rows = {tuple(v) for v in x}
    assert all(tuple(c) in rows for s in starts for c in s)
    fits = ll.lloyd(points, starts)
    for fit, start in zip(fits, starts):
        assert fit.inertia == pytest.approx(brute(x, start))


def test_one_scan_per_iteration(points, monkeypatch):
    scans, once = [], ll._sums

    def counted(points, fits):
        scans.append(len(fits))
        return once(points, fits)

    monkeypatch.setattr(ll, "_sums", counted)
    starts = ll.seed_centres(points, [2, 3, 4], [0, 0, 0])
    fits = ll.lloyd(points, starts)
    assert len(scans) == max(f.scans for f in fits) and scans[0] == 3 and scans == sorted(scans, reverse=True)


def test_fewer_different_points_than_centres(spark):
    df = spark.createDataFrame([(k, [float(k % 2), 1.0]) for k in range(30)], "id long, features array<double>")
    rows = {r["k"]: r["inertia"] for r in elbow(df, ks=(1, 2, 4), starts=2, key="id").collect()}
    assert rows == {1: pytest.approx(7.5), 2: 0.0, 4: 0.0}
    none = {r["k"]: r["inertia"] for r in elbow(df.limit(0), ks=(1, 2), starts=1).collect()}
    assert none[2] is None


def test_draws_follow_the_distance(spark):
    h = np.arange(200_000, dtype=np.int64)
    u = ll.uniform(h, 3, 1)
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.005
    assert abs(np.corrcoef(u, ll.uniform(h, 3, 2))[0, 1]) < 0.01
    weights = np.where(h % 2, 3.0, 1.0)
    wins = [(-np.log(ll.uniform(h[:2], s, 0)) / weights[:2]).argmin() for s in range(4000)]
    assert abs(np.mean(wins) - 0.75) < 0.03


def test_assign_keeps_missing_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "id long, features array<double>")
    out = kmeans_assign(df.withColumn("distance", F.lit(9)), [(7, [1.0, 0.0]), (2, [-1.0, 0.0])])
    got = {r["id"]: (r["cluster_label"], r["distance"]) for r in out.collect()}
    assert got == {1: (7, 0.0), 2: (None, None), 3: (2, 1.0)}


def test_packed_points_are_the_same_points(spark):
    df = spark.createDataFrame([(k, [float(k), k / 3.0]) for k in range(50)], "id long, features array<double>")
    plain = ll.stored_points(df, key="id")
    packed = ll.packed_points(plain)
    assert dict(packed.dtypes) == {"x": "binary", "h": "binary"}
    a, b = (ll.seed_centres(p, [3], [1])[0] for p in (plain, packed))
    assert a.tolist() == b.tolist()
    one, two = (ll.lloyd(p, [a])[0] for p in (plain, packed))
    assert abs(one.inertia - two.inertia) < 1e-9 and np.allclose(one.centres, two.centres)

import numpy as np
import pytest
from pyspark.sql import functions as F

from logmetrics.operators import descent as d
from logmetrics.sources.ledger import ledger_rows


@pytest.mark.parametrize("hidden,loss", [("relu", "softmax"), ("tanh", "squared")])
def test_gradient_is_the_slope(hidden, loss):
    net = d.Network((4, 6, 3 if loss == "softmax" else 1), hidden, loss)
    draw = np.random.default_rng(0)
    x, flat = draw.normal(size=(7, 4)), draw.normal(size=net.size)
    y = draw.integers(0, 3, 7).astype(float)
    gradient, value, _ = net.gradient(flat, x, y)
    for k in range(net.size):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        slope = (net.gradient(up, x, y)[1] - net.gradient(down, x, y)[1]) / 2e-6
        assert slope == pytest.approx(gradient[k], rel=1e-4, abs=1e-4)
    assert value == pytest.approx(net.errors(net.forward(flat, x)[-1], y)[0])


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 3))
    data = [(k, v.tolist(), float(v[0] > 0), float(v @ [1.0, -2.0, 0.5])) for k, v in enumerate(x)]
    return spark.createDataFrame(data, "id long, features array<double>, side double, value double")


class Stop(Exception):
    pass


def run(rows, place, label, network, stop_after=None, rate=1.0, **more):
    def stop(epoch, metrics):
        if epoch == stop_after:
            raise Stop

    return d.fit_with_checkpoints(
        rows.where("id % 4 > 0"), rows.where("id % 4 = 0"), network, key="id", run_id="r", store=f"{place}/models",
        ledger=f"{place}/ledger", rate=rate, label=label, batch_rows=64, block_rows=16, learning_rate=0.02,
        on_epoch=stop, **more,
    )


@pytest.mark.parametrize("label,network", [("side", d.classifier([3, 8, 2])), ("value", d.forecaster(3, 8))])
def test_an_interrupted_run_ends_in_the_same_weights(spark, rows, tmp_path, label, network, monkeypatch):
    monkeypatch.setattr(d, "FAN_IN", 2)
    whole = run(rows, tmp_path / "a", label, network, max_epochs=5)
    with pytest.raises(Stop):
        run(rows.repartition(5), tmp_path / "b", label, network, stop_after=3, max_epochs=5)
    resumed = run(rows.repartition(2), tmp_path / "b", label, network, max_epochs=5)
    assert (resumed.weights == whole.weights).all() and (resumed.second == whole.second).all()
    assert resumed.steps == whole.steps == 5 * 4
    book = ledger_rows(spark, str(tmp_path / "b/ledger")).orderBy("seq").collect()
    assert [(r["seq"], r["epoch"], r["recovery"]) for r in book] == [(k, k, True) for k in range(1, 6)] + [(6, 5, False)]
    assert book[4]["metrics"]["val_loss"] < book[0]["metrics"]["val_loss"]
    guessed = d.predict(rows, network, resumed.weights).select("id", "prediction").collect()
    x = np.array([r["features"] for r in rows.orderBy("id").collect()])
    out = network.forward(resumed.weights, x)[-1]
    want = out.argmax(axis=1) if label == "side" else out[:, 0]
    assert [r["prediction"] for r in sorted(guessed)] == pytest.approx(want.tolist())


def test_the_newest_state_is_loaded_although_epochs_are_rewound(spark, rows, tmp_path):
    net = d.classifier([3, 4, 2])
    with pytest.raises(Stop):
        run(rows, tmp_path, "side", net, stop_after=4, rate=0.5, max_epochs=5)
    state = run(rows, tmp_path, "side", net, rate=0.5, max_epochs=5)
    epochs = [r["epoch"] for r in ledger_rows(spark, str(tmp_path / "ledger")).orderBy("seq").collect()]
    assert epochs == [1, 2, 3, 4, 3, 4, 5, 5] and state.steps == 4 * 7


def test_missing_values_take_no_part(spark, rows):
    holes = rows.withColumn("side", F.when(F.col("id") % 2 == 0, F.col("side")))
    holes = holes.withColumn("features", F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(None), F.lit(2.0))).otherwise(F.col("features")))
    blocks, batches, count = d.training_blocks(holes, "id", label="side", batch_rows=32, block_rows=16)
    assert blocks.agg(F.sum(F.size("y"))).first()[0] == 100 and (batches, count) == (4, 7)
    net = d.classifier([3, 2])
    assert d.predict(holes, net, net.start(0)).where("prediction is null").count() == 100
    assert np.isnan(d.evaluate(blocks.limit(0), net, net.start(0))[0])


def test_many_batches_step_side_by_side(spark, rows, tmp_path, monkeypatch):
    """The jobs of an epoch do not grow with its batches, and a resumed run still ends in the same weights."""
    monkeypatch.setattr(d, "ROUNDS", 3)
    monkeypatch.setattr(d, "LANE", 2)
    monkeypatch.setattr(d, "FAN_IN", 2)
    net, options = d.forecaster(3, 8), {"key": "id", "label": "value", "batch_rows": 16, "block_rows": 8, "learning_rate": 0.02}

    def fit(rows, place, epochs, on_epoch=None):
        parts = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
        return d.fit_with_checkpoints(
            *parts, net, run_id="r", store=f"{place}/models", ledger=f"{place}/ledger", max_epochs=epochs, on_epoch=on_epoch, **options
        )

    def stop(epoch, metrics):
        if epoch == 2:
            raise Stop

    seen = []
    whole = fit(rows, tmp_path / "a", 4, lambda epoch, metrics: seen.append(metrics["loss"]))
    assert whole.steps == 4 * 3 * 2  # 15 batches in 8 lanes, all of them in each epoch
    assert seen[-1] < seen[0] / 2
    with pytest.raises(Stop):
        fit(rows.repartition(5), tmp_path / "b", 4, stop)
    resumed = fit(rows.repartition(2), tmp_path / "b", 4)
    assert (resumed.weights == whole.weights).all() and (resumed.second == whole.second).all()

    blocks, batches, _ = d.training_blocks(rows.where("id % 4 > 0"), "id", label="value", batch_rows=16, block_rows=8)
    assert batches == 15
    lane = blocks.where("lane = 1").orderBy("block").collect()
    want, at = d.State.new(net, 0), {b: [r for r in lane if r["batch"] == b] for b in (2, 3)}
    for batch in (2, 3):
        x, y = (np.array([v for r in at[batch] for v in r[c]]) for c in "xy")
        want.step(net.gradient(want.weights, x.reshape(-1, 3), y)[0] / 16, 0.02)
    got, _, _, n = d.lane_steps(blocks.where("lane = 1"), 1, 4, net, d.State.new(net, 0), 0.02)
    assert n == 32 and got.steps == 2 and got.weights == pytest.approx(want.weights)


@pytest.mark.parametrize("size", [None, 2 * 16 * 3 * 8, 1])
def test_a_chained_run_steps_from_batch_to_batch(rows, tmp_path, monkeypatch, size):
    """With many batches too, and whether a job takes all of an epoch's, two, or a part of one: a plain loop's weights."""
    if size:
        monkeypatch.setattr(d, "CHAIN_BYTES", size)
    monkeypatch.setattr(d, "ROUNDS", 3)
    monkeypatch.setattr(d, "LANE", 2)
    net, train = d.forecaster(3, 8), rows.where("id % 4 > 0")
    got = d.fit_with_checkpoints(
        train, rows.where("id % 4 = 0"), net, key="id", run_id="r", store=f"{tmp_path}/models", ledger=f"{tmp_path}/ledger",
        max_epochs=2, label="value", batch_rows=16, block_rows=8, learning_rate=0.02, chained=True,
    )
    blocks, batches, _ = d.training_blocks(train, "id", label="value", batch_rows=16, block_rows=8, lane=1)
    at, want = {}, d.State.new(net, 0)
    for r in blocks.orderBy("block").collect():
        at.setdefault(r["batch"], []).append(r)
    for epoch in (1, 2):
        for batch in np.random.default_rng([0, epoch]).permutation(batches):
            x, y = (np.array([v for r in at[batch] for v in r[c]]) for c in "xy")
            want.step(net.gradient(want.weights, x.reshape(-1, 3), y)[0] / len(y), 0.02)
    assert batches == 15 and got.steps == want.steps == 30
    assert got.weights == pytest.approx(want.weights) and got.second == pytest.approx(want.second)

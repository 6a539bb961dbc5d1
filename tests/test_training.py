import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from logmetrics.operators import descent, learn
from logmetrics.operators import recovery as rc
from logmetrics.operators.windows import WindowSpec, sliding_windows, window_slices
from logmetrics.sources import ledger as store


def ledger(spark, rows):
    return spark.createDataFrame(rows, store.LEDGER_SCHEMA)


@pytest.mark.parametrize(
    ("epochs", "recovery", "rate", "want"),
    [(10, True, 0.88, 8), (10, False, 0.88, 0), (10, True, 0.0, 0), (0, True, 0.88, 0), (10, True, -1.0, 0)],
)
def test_resume_point(spark, epochs, recovery, rate, want):
    rows = ledger(spark, [("a", 1, epochs, 30, recovery, {})])
    state = rc.resume_point(store.latest_state(rows), rate).first()
    assert state["resume_epoch"] == want


def test_latest_state_is_the_last_row_written(spark):
    rows = ledger(spark, [("a", 1, 9, 30, True, {"acc": 0.5}), ("a", 2, 3, 30, True, {"acc": 0.7}),
                          ("b", 5, 1, 30, False, {})])
    got = {r["run_id"]: (r["epochs"], r["acc"], r["recovery"]) for r in store.latest_state(rows).collect()}
    assert got == {"a": (3, 0.7, True), "b": (1, 0.0, False)}


def test_missing_ledger_gives_defaults(spark, tmp_path):
    rows = store.ledger_rows(spark, str(tmp_path / "none"))
    wanted = spark.createDataFrame([("x",)], "run_id string")
    state = store.ledger_read(rows, wanted).first()
    assert tuple(state) == ("x", 0, 0.0, 0, 0, False)


def test_damaged_ledger_is_an_error(spark, tmp_path):
    """A damaged file must not rewind a run silently."""
    (tmp_path / "part-0.parquet").write_text("not a table")
    with pytest.raises(Exception, match="part-0"):
        store.ledger_rows(spark, str(tmp_path)).count()


def resumed(spark):
    rows = ledger(spark, [("a", 1, 10, 30, True, {}), ("b", 1, 10, 30, False, {}), ("c", 1, 0, 30, True, {})])
    return rc.resume_point(store.latest_state(rows), 0.88), store.latest_checkpoint(rows)


def test_recovery_report(spark):
    state, _ = resumed(spark)
    got = {r["run_id"]: tuple(r)[1:] for r in rc.recovery_report(state).collect()}
    assert got["a"] == (80, 8, 11, 10, "recovery")
    # The interrupt report rewinds whatever the flag says.
    assert got["b"] == (None, 8, 11, None, "Not found recovery point.")
    assert got["c"] == (None, 0, 1, 0, "recovery")


def test_recovery_epochs(spark):
    state, _ = resumed(spark)
    got = rc.recovery_epochs(state).orderBy("epoch").collect()
    assert [r["line"] for r in got] == [f"Epoch {k}/30 completed. (recovery)" for k in range(1, 9)]
    got = rc.recovery_epochs(state, rc.POINT).orderBy("epoch").collect()
    assert [r["line"] for r in got] == [f"Epoch {k}/30 recovery point." for k in range(1, 9)]


def test_history_counts_each_epoch_once(spark):
    """Epoch 2 is trained again after a resume; the closing row repeats no epoch."""
    rows = ledger(spark, [("a", 1, 1, 3, True, {"loss": 3.0}), ("a", 2, 2, 3, True, {"loss": 2.0}),
                          ("a", 3, 2, 3, True, {"loss": 1.5}), ("a", 4, 3, 3, True, {"loss": 1.0}),
                          ("a", 5, 3, 3, False, {"loss": 1.0}), ("b", 1, 9, 9, False, {})])
    got = {(r["epoch"], r["value"]) for r in rc.history_table(rows).collect()}
    assert got == {(1, 3.0), (2, 1.5), (3, 1.0)} and rc.history_table(rows).count() == 3
    assert [tuple(r) for r in store.latest_checkpoint(rows).collect()] == [("a", 3)]


def test_restore_epoch(spark):
    state, newest = resumed(spark)
    latest = {r["run_id"]: r["load_epoch"] for r in rc.restore_epoch(state, newest).collect()}
    assert latest == {"a": 10, "b": None, "c": None}
    rewound = rc.restore_epoch(state, newest, "resume_epoch").filter("run_id = 'a'").first()
    assert rewound["load_epoch"] == 8


def test_history_table(spark):
    rows = ledger(spark, [("a", 1, 1, 2, True, {"loss": 2.0, "val_loss": 3.0}),
                          ("a", 2, 2, 2, True, {"loss": 1.0, "val_loss": 2.5})])
    table = rc.history_table(rows)
    assert {tuple(r)[1:] for r in table.collect()} == {
        ("train", 1, "loss", 2.0), ("train", 2, "loss", 1.0),
        ("validation", 1, "loss", 3.0), ("validation", 2, "loss", 2.5),
    }
    low, high = rc.history_bounds(table).select("low", "high").first()
    assert (low, high) == pytest.approx((0.95, 3.05))


def test_evaluate_classifier(spark):
    rows = spark.createDataFrame(
        [(0, 0.0, [0.5, 0.5]), (1, 0.0, [0.9, 0.1])], "label int, prediction double, probability array<double>"
    )
    got = learn.evaluate_classifier(rows).first()
    assert got["accuracy"] == 0.5 and got["percent"] == "50.00%"
    assert got["loss"] == pytest.approx(-(np.log(0.5) + np.log(0.1)) / 2)


def test_evaluate_regressor(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 1.0)], "label double, prediction double")
    assert tuple(learn.evaluate_regressor(rows).first()) == (2.5, 1.5)


@pytest.fixture(scope="module")
def shapes(spark):
    rng = np.random.default_rng(0)
    rows = [(k, (rng.normal(size=4) + 3 * (k % 3) * np.array([1, -1, 0, 1])).tolist(), k % 3) for k in range(240)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    return df.filter("id < 180"), df.filter("id >= 180")


def test_training_resumes_where_it_stopped(spark, shapes, tmp_path):
    train, held = shapes
    options = {"run_id": "r", "layers": [4, 5, 3], "store": str(tmp_path / "m"),
               "ledger": str(tmp_path / "l"), "max_epochs": 5, "step": 8, "rate": 0.7}
    seen = []

    def stop(epoch, metrics):
        seen.append(epoch)
        if len(seen) == 3:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        learn.fit_with_checkpoints(spark, train, held, on_epoch=stop, **options)
    model = learn.fit_with_checkpoints(spark, train, held, on_epoch=stop, **options)
    assert seen == [1, 2, 3, 3, 4, 5]  # int(3 * 0.7) = 2, so epoch 3 runs again
    rows = store.ledger_rows(spark, options["ledger"])
    last = store.latest_state(rows).first()
    assert last["recovery"] is False and last["epochs"] == 5
    by_seq = {r["seq"]: r["metrics"] for r in rows.collect()}
    assert by_seq[6]["val_accuracy"] > 0.9 and by_seq[6]["loss"] < by_seq[1]["loss"]
    reloaded = store.model_load(options["store"], "r", 5)
    assert np.allclose(reloaded.weights.toArray(), model.weights.toArray())


def test_finished_run_starts_over(spark, tmp_path):
    path = str(tmp_path / "l")
    store.ledger_append(store.ledger_entry(spark, "r", 1, 5, 5, False), path)
    wanted = spark.createDataFrame([("r",)], "run_id string")
    state = rc.resume_point(store.ledger_read(store.ledger_rows(spark, path), wanted), 0.88)
    assert state.first()["resume_epoch"] == 0


@pytest.mark.parametrize("kind", ["linear", "gbt"])
def test_window_forecaster(spark, kind):
    rows = spark.createDataFrame(
        [("train", k, float(k % 7), float(k)) for k in range(200)], "split string, idx long, a double, b double"
    )
    spec = WindowSpec(columns=("a", "b"), label_columns=("b",), input_width=3)
    windows = window_slices(sliding_windows(rows, spec), spec)
    model = learn.window_forecaster(windows, kind=kind)
    predicted = model.transform(learn.forecast_rows(windows))
    errors = learn.evaluate_regressor(predicted).first()
    assert errors["mae"] < (1e-3 if kind == "linear" else 10)
    with pytest.raises(ValueError):
        learn.window_forecaster(windows, kind="other")


def points(spark, n=1024):
    rng = np.random.default_rng(0)
    rows = [((rng.normal(size=4) + 1.5 * (k % 3) * np.array([1, -1, 0, 1])).tolist(), k % 3) for k in range(n)]
    return spark.createDataFrame(rows, "x array<double>, y int")


@pytest.mark.parametrize(("steps", "parts"), [(0, 8), (1, 8), (20, 8), (20, 3)])
def test_perceptron_takes_the_steps_of_sparks(spark, steps, parts):
    rows = points(spark, 1024 if parts == 8 else 301).repartition(parts).cache()
    trainer = MultilayerPerceptronClassifier(layers=[4, 16, 3], featuresCol="x", labelCol="y", maxIter=steps, seed=5)
    want = trainer.fit(learn.labelled_vectors(rows, "x", "y"))
    got = learn.mlp_classifier(rows, [4, 16, 3], features="x", label="y", max_iter=steps, seed=5)
    assert np.allclose(got.weights.toArray(), want.weights.toArray(), rtol=0, atol=1e-8)
    assert got.getMaxIter() == steps and not got.isSet(got.initialWeights)


def test_perceptron_uses_all_cores_whatever_the_layout(spark, monkeypatch):
    """Before, one partition of rows was one task."""
    rows, seen = points(spark, 301).coalesce(1).cache(), []
    whole = descent.whole_gradient

    def noted(packed, tasks, *rest):
        seen.append((packed.rdd.getNumPartitions(), tasks, packed.count()))
        return whole(packed, tasks, *rest)

    monkeypatch.setattr(descent, "whole_gradient", noted)
    learn.mlp_classifier(rows, [4, 6, 3], features="x", label="y", max_iter=2)
    cores = spark.sparkContext.defaultParallelism
    assert set(seen) == {(cores, cores, 3)}


def test_perceptron_gradient_is_the_slope_of_its_loss():
    rng = np.random.default_rng(1)
    network, x, y = descent.Network((3, 4, 2), hidden="sigmoid"), rng.normal(size=(9, 3)), rng.integers(0, 2, 9)
    flat = rng.normal(size=network.size)
    gradient = network.gradient(flat, x, y)[0]
    for k in range(network.size):
        step = np.eye(network.size)[k] * 1e-6
        slope = (network.gradient(flat + step, x, y)[1] - network.gradient(flat - step, x, y)[1]) / 2e-6
        assert gradient[k] == pytest.approx(slope, abs=1e-6)


BAD = ["(array(0D, 1D), null)", "(array(0D, null), 0)", "(null, 0)", "(array(0D), 0)", "(array(0D, 1D), 2)", "(array(0D, 1D), 0.5)"]


@pytest.mark.parametrize("bad", BAD)
def test_perceptron_refuses_rows_it_cannot_learn(spark, bad):
    rows = spark.sql(f"select features, cast(label as double) label from values (array(1D, 1D), 1), {bad} as t(features, label)")
    with pytest.raises(Exception, match="must"):
        learn.mlp_classifier(rows, [2, 3, 2], max_iter=2)

"""Queries over training, evaluation, resume and streams."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from logmetrics.operators import descent
from logmetrics.operators import forest as rf
from logmetrics.operators import learn
from logmetrics.operators import recovery as rc
from logmetrics.operators.logs import build_log_frame
from logmetrics.operators.positions import chrono_split
from logmetrics.operators.text import embed_lookup
from logmetrics.operators.windows import WindowSpec, sliding_windows, window_slices
from logmetrics.plans import inputs as i
from logmetrics.plans import jobs
from logmetrics.plans.catalog import query
from logmetrics.session import materialize, scratch_path, sized_broadcast, spread
from logmetrics.sources import ledger as store
from logmetrics.streaming import logs as streams

# --- models -----------------------------------------------------------------


def _parts(spark, sf_dir):
    """Train and held-out rows: the first 70 percent of the vectors and the rest."""
    rows = chrono_split(i.vectors(spark, sf_dir), "vec_id")
    train = F.col("split") == "train"
    return rows.filter(train).drop("idx", "split"), rows.filter(~train).drop("idx", "split")


@query("""SELECT event_id, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1.0::DOUBLE
  AS prediction FROM events""")
def mlp_classifier(spark, sf_dir):
    """Five separate points with five labels: every row gets its own."""
    types = ["click", "error", "purchase", "signup", "view"]
    places = F.array(*[(F.col("event_type") == x).cast("double") for x in types])
    label = F.array_position(F.array(*map(F.lit, types)), F.col("event_type")) - 1
    dealt = spread(i.events(spark, sf_dir).select("event_id", "event_type"))
    rows = dealt.select("event_id", places.alias("features"), label.alias("label"))
    model = learn.mlp_classifier(rows, [5, 512, 5], max_iter=30)
    return learn.classify(rows, model).select("event_id", "prediction")


@query()
def mlp_classifier_vectors(spark, sf_dir):
    train, held = _parts(spark, sf_dir)
    model = learn.mlp_classifier(train, [64, 512, 10], max_iter=30)
    return learn.classify(held, model).select("vec_id", "label", "prediction")


@query("""WITH p AS (
  SELECT user_id % 3 AS label, event_id % 3 AS prediction,
         [0.1::DOUBLE + (event_id % 7) / 10.0::DOUBLE, 0.2::DOUBLE, 0.0::DOUBLE] AS probability
  FROM events)
SELECT round(avg((label = prediction)::INTEGER), 6) AS accuracy,
       round(avg(-ln(greatest(probability[label + 1], 1e-15::DOUBLE))), 6) AS loss,
       printf('%5.2f%%', avg((label = prediction)::INTEGER) * 100) AS percent
FROM p""")
def evaluate_classifier(spark, sf_dir):
    predicted = i.events(spark, sf_dir).select(
        (F.col("user_id") % 3).alias("label"),
        (F.col("event_id") % 3).alias("prediction"),
        F.array(
            F.lit(0.1) + (F.col("event_id") % 7) / F.lit(10.0), F.lit(0.2), F.lit(0.0)
        ).alias("probability"),
    )
    return learn.evaluate_classifier(predicted).select(
        F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss"), "percent"
    )


@query("""SELECT round(avg((user_id - value) * (user_id - value)), 6) AS mse,
  round(avg(abs(user_id - value)), 6) AS mae FROM events""")
def evaluate_regressor(spark, sf_dir):
    rows = i.events(spark, sf_dir).select("value", F.col("user_id").cast("double").alias("guess"))
    found = learn.evaluate_regressor(rows, "value", "guess")
    return found.select(F.round("mse", 6).alias("mse"), F.round("mae", 6).alias("mae"))


ONE_LAG = WindowSpec(columns=("value",), label_columns=("value",), input_width=1)


@query("""WITH indexed AS (
  SELECT value::FLOAT::DOUBLE AS value, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx
  FROM events),
size AS (SELECT floor(count(*) * 0.7::DOUBLE) AS train FROM events),
pairs AS (
  SELECT a.value AS x, b.value AS y FROM indexed a JOIN indexed b ON b.idx = a.idx + 1, size
  WHERE b.idx < train)
SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept,
       count(*) AS windows FROM pairs""")
def window_forecaster(spark, sf_dir):
    rows = chrono_split(i.events(spark, sf_dir).select("event_id", "ts", "value"), "ts", "event_id")
    windows = window_slices(sliding_windows(rows, ONE_LAG), ONE_LAG)
    train = materialize(windows.filter(F.col("split") == "train"), "lags")
    model = learn.window_forecaster(train, solver="normal")
    return train.agg(
        F.round(F.lit(float(model.coefficients[0])), 6).alias("slope"),
        F.round(F.lit(float(model.intercept)), 6).alias("intercept"),
        F.count(F.lit(1)).alias("windows"),
    )


@query()
def weather_forecast(spark, sf_dir):
    """The weather job end to end: features, windows, fit on train, error per split."""
    windows, _ = jobs.weather_windows(i.weather(spark, sf_dir), "Date Time", "event_id")
    stored = materialize(windows, "windows")
    model = learn.window_forecaster(stored.filter(F.col("split") == "train"), regParam=0.1)
    predicted = model.transform(learn.forecast_rows(stored))
    miss = F.col("prediction") - F.col("label")
    return predicted.groupBy("split").agg(
        F.avg(miss * miss).alias("mse"), F.avg(F.abs(miss)).alias("mae"),
        F.count(F.lit(1)).alias("windows"),
    )


# --- ledger and resume ------------------------------------------------------

LAST = f"""{i.LEDGER},
last AS (
  SELECT run_id, arg_max(epoch, seq) AS epochs, arg_max(max_epochs, seq) AS max_epochs,
         arg_max(recovery, seq) AS recovery
  FROM ledger GROUP BY run_id),
resumed AS (
  SELECT *, greatest(floor(epochs * 0.88::DOUBLE), 0)::BIGINT AS rewound,
    (CASE WHEN recovery THEN greatest(floor(epochs * 0.88::DOUBLE), 0) ELSE 0 END)::BIGINT
    AS resume_epoch
  FROM last)"""


def _resumed(spark, sf_dir):
    return rc.resume_point(store.latest_state(i.ledger(spark, sf_dir)), 0.88)


@query(f"WITH {LAST} SELECT run_id, epochs, recovery, resume_epoch FROM resumed")
def resume_point(spark, sf_dir):
    return _resumed(spark, sf_dir).select("run_id", "epochs", "recovery", "resume_epoch")


@query(f"""WITH {LAST}
SELECT run_id, 'latest' AS weights, CASE WHEN recovery THEN epochs END::BIGINT AS load_epoch
FROM resumed
UNION ALL
SELECT run_id, 'resume_epoch', CASE WHEN recovery THEN resume_epoch END FROM resumed""")
def restore_epoch(spark, sf_dir):
    resumed = _resumed(spark, sf_dir)
    newest = store.latest_checkpoint(i.ledger(spark, sf_dir))
    kinds = [
        rc.restore_epoch(resumed, newest, weights).select(
            "run_id", F.lit(weights).alias("weights"), "load_epoch"
        )
        for weights in ("latest", "resume_epoch")
    ]
    return kinds[0].unionByName(kinds[1])


@query(f"""WITH {LAST},
e AS (SELECT run_id, max_epochs::BIGINT AS max_epochs, unnest(range(1, resume_epoch + 1)) AS epoch
      FROM resumed)
SELECT run_id, epoch, max_epochs,
       'Epoch ' || epoch || '/' || max_epochs || ending AS line
FROM e, (VALUES (' completed. (recovery)'), (' recovery point.')) AS t(ending)""")
def recovery_epochs(spark, sf_dir):
    """The lines of either history text."""
    resumed = _resumed(spark, sf_dir)
    return rc.recovery_epochs(resumed).unionByName(rc.recovery_epochs(resumed, rc.POINT))


@query(f"""WITH {LAST}
SELECT run_id,
  CASE WHEN recovery THEN floor(resume_epoch::DOUBLE / nullif(epochs, 0) * 100) END::BIGINT
    AS recover_rate,
  rewound AS interrupt_latest, (epochs + 1)::BIGINT AS interrupt_target,
  CASE WHEN recovery THEN epochs END::BIGINT AS history_target,
  CASE WHEN recovery THEN 'recovery' ELSE 'Not found recovery point.' END AS note
FROM resumed""")
def recovery_report(spark, sf_dir):
    return rc.recovery_report(_resumed(spark, sf_dir))


HISTORY = f"""{i.LEDGER},
trained AS (
  SELECT run_id, epoch, arg_max(acc, seq) AS acc, arg_max(loss, seq) AS loss
  FROM ledger WHERE recovery GROUP BY run_id, epoch),
history AS (
  SELECT run_id, 'train' AS part, epoch::BIGINT AS epoch, 'acc' AS metric, acc AS value FROM trained
  UNION ALL SELECT run_id, 'train', epoch, 'loss', loss FROM trained
  UNION ALL SELECT run_id, 'validation', epoch, 'acc', loss / 2000.0::DOUBLE FROM trained
  UNION ALL SELECT run_id, 'validation', epoch, 'loss', loss * 2.0::DOUBLE FROM trained)"""


@query(f"WITH {HISTORY} SELECT run_id, part, epoch, metric, value FROM history")
def history_table(spark, sf_dir):
    return rc.history_table(i.ledger(spark, sf_dir))


@query(f"""WITH {HISTORY}
SELECT run_id, metric, min(value) - 0.05::DOUBLE AS low, max(value) + 0.05::DOUBLE AS high
FROM history GROUP BY run_id, metric""")
def history_bounds(spark, sf_dir):
    return rc.history_bounds(rc.history_table(i.ledger(spark, sf_dir)))


class Interrupted(Exception):
    """Raised between two epochs to stop a run."""


def _interrupted_run(spark, train, held, network, **options):
    """Train, stop after ten epochs, resume at int(10 * 0.88) = 8, finish thirty; the ledger."""
    place = scratch_path(spark, "training")
    options |= {
        "run_id": "run1", "store": f"{place}/models", "ledger": f"{place}/ledger", "max_epochs": 30,
        "rate": 0.88, "learning_rate": 0.01, "chained": True,
    }

    def stop(epoch, metrics):
        if epoch == 10:
            raise Interrupted

    try:
        descent.fit_with_checkpoints(train, held, network, on_epoch=stop, **options)
    except Interrupted:
        pass
    descent.fit_with_checkpoints(train, held, network, **options)
    rows = store.ledger_rows(spark, f"{place}/ledger")
    first = rows.agg(F.min_by("metrics", "seq")["loss"].alias("m")).scalar()
    lower = F.when(F.col("seq") > 1, F.col("metrics")["loss"] < first)
    return rows.select(
        "run_id", "seq", "epoch", "max_epochs", "recovery", lower.alias("lower"),
        F.array_join(F.array_sort(F.map_keys("metrics")), ",").alias("metrics"),
    )


def _ledger_sql(metrics: str) -> str:
    return f"""WITH seqs AS (SELECT unnest(range(1, 34)) AS seq)
SELECT 'run1' AS run_id, seq, CASE WHEN seq <= 10 THEN seq WHEN seq <= 32 THEN seq - 2 ELSE 30 END::INTEGER AS epoch,
  30 AS max_epochs, seq < 33 AS recovery, CASE WHEN seq BETWEEN 2 AND 32 THEN true END AS lower,
  CASE WHEN seq < 33 THEN '{metrics}' ELSE '' END AS metrics
FROM seqs"""


@query(_ledger_sql("accuracy,loss,val_accuracy,val_loss"))
def fit_with_checkpoints(spark, sf_dir):
    """The image classifier's run: 512 hidden units, thirty epochs, one interruption."""
    train, held = _parts(spark, sf_dir)
    network = descent.classifier([64, 512, 10])
    return _interrupted_run(spark, train, held, network, key="vec_id", block_rows=64)


@query(_ledger_sql("loss,mae,val_loss,val_mae"))
def fit_forecaster(spark, sf_dir):
    """The weather forecaster's run: 24 rows in, 32 units, thirty epochs, one interruption."""
    windows, spec = jobs.weather_windows(i.weather(spark, sf_dir), "Date Time", "event_id")
    rows = materialize(descent.forecast_inputs(windows), "windows")
    parts = [rows.filter(F.col("split") == split) for split in ("train", "validation")]
    network = descent.forecaster(24 * len(spec.columns), 32)
    return _interrupted_run(spark, *parts, network, key="idx")


# --- streams ----------------------------------------------------------------


def _event_stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(i.events(spark, sf_dir).schema)
    if os.path.isfile(path):  # a single file: stream its folder, this name only
        return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return reader.parquet(path)


@query(f"""WITH {i.MINUTES}
SELECT time, message, log_type FROM minutes
WHERE time <= (SELECT max(time) - INTERVAL 1 HOUR FROM minutes)""")
def stream_last_per_key(spark, sf_dir):
    raw = i.log_rows(_event_stream(spark, sf_dir))
    frame = i.by_minute(build_log_frame(raw))
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    streams.append_to(streams.stream_last_per_key(frame), out, state).awaitTermination()
    return spark.read.parquet(out)


@query(f"WITH {i.MINUTES} SELECT time, message, log_type FROM minutes")
def stream_all_keys(spark, sf_dir):
    """All keys of the stream: those closed by the watermark and those still open at its end."""
    frame = i.by_minute(build_log_frame(i.log_rows(_event_stream(spark, sf_dir))))
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    streams.append_to(streams.stream_last_per_key(frame), out, state).awaitTermination()
    closed = spark.read.parquet(out)
    return closed.unionByName(streams.open_keys(spark, state, frame.schema))


@query(f"""WITH {i.LOGS}
SELECT log_type, log_time AS time, {i.sql_clean('message')} AS message FROM logs""")
def stream_cleaned_logs(spark, sf_dir):
    stream = streams.stream_envelopes(spark, i.landed_envelopes(spark, sf_dir))
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    cleaned = stream.select("log_type", "time", "message")
    streams.append_to(cleaned, out, state).awaitTermination()
    return spark.read.parquet(out)


@query()
def stream_log_scores(spark, sf_dir):
    """Fit a forest on stored logs, then score the landed responses as a stream."""
    words = materialize(i.word_vectors(spark, sf_dir), "words")
    logs = i.logs(spark, sf_dir)
    known = embed_lookup(logs, sized_broadcast(words), key="seq").filter(F.col("features").isNotNull())
    forest = materialize(
        rf.rcf_fit(materialize(known, "known"), "seq", num_trees=100, tree_size=256), "forest"
    )
    stream = streams.stream_envelopes(spark, i.landed_envelopes(spark, sf_dir))
    keyed = stream.select(
        F.concat_ws("/", "log_type", "searchTime", F.col("pos").cast("string")).alias("row_key"),
        "time", "message",
    )
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    streams.stream_log_scores(
        keyed, words, forest, out, state, key="row_key"
    ).awaitTermination()
    return spark.read.parquet(out).select("row_key", "time", "message", "score")

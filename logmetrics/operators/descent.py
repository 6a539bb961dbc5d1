"""Dense networks trained by data-parallel mini-batch descent that resumes exactly.

Rows stand in a seeded random order, cut into blocks; a block is one stored row
(its features and labels as flat arrays), so it is always worked on whole and in
the same order. A step reads one batch of blocks, each task adds to a gradient
block by block, and gradients are summed in a tree of fixed groups in block
order. So the same data, seed and state give the same weights to the last bit,
whatever the number of tasks. Weights, both Adam moments and the step count are
stored after every epoch: a run that goes on from them equals one that was never
interrupted.

A chained run steps one batch after the other, each from the weights the one
before it left, whatever the number of rows. A job takes the steps of as many
batches as stand in CHAIN_BYTES in one task, in the epoch's order, and hands the
state on; a batch that alone is longer is one job whose tasks share its gradient.

A run in lanes stores LANE batches in one file each, for every number of rows. A
round's lanes start from the same state, each takes the steps of its batches in
its own task, and weights and moments of all lanes are averaged by their rows
(Stich 2019, "Local SGD converges fast and communicates little"): an epoch takes
at most ROUNDS * LANE steps one after the other. Either way every row is in one
batch of ``batch_rows`` rows an epoch.

The driver and a task hold the network's parameters, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmetrics.operators.positions import shuffled_index
from logmetrics.operators.quasi_newton import minimize
from logmetrics.operators.recovery import resume_point
from logmetrics.session import scratch_path
from logmetrics.sources.ledger import (
    latest_checkpoint,
    ledger_append,
    ledger_entry,
    ledger_read,
    ledger_rows,
    model_path,
)

#: Gradients summed in one node of the tree.
FAN_IN = 32
#: Rounds of an epoch whose batches stand in lanes, and batches of a lane.
ROUNDS, LANE = 4, 4
#: Bytes of features whose batches one job steps through.
CHAIN_BYTES = 64 * 1024 * 1024
#: Rows of a packed block, as in Spark's perceptron (their units stay in the cache); bytes of a task's rows.
PACKED_ROWS, TASK_BYTES = 128, 16 * 1024 * 1024
SMALLEST = 1e-15


def _sigmoid(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-z)), in place."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(z, out=z), out=z)
    z += 1.0
    return np.reciprocal(z, out=z)


_UNITS = {"relu": lambda z: np.maximum(z, 0.0), "tanh": np.tanh, "sigmoid": _sigmoid}
#: Slopes of the units, from their outputs.
_SLOPES = {"relu": lambda out: out > 0, "tanh": lambda out: 1.0 - out**2, "sigmoid": lambda out: out - out * out}


@dataclass(frozen=True)
class Network:
    """Layer widths, hidden units (``relu``, ``tanh`` or ``sigmoid``) and loss (``softmax`` or ``squared``)."""

    layers: tuple[int, ...]
    hidden: str = "relu"
    loss: str = "softmax"

    def shapes(self) -> list[tuple[int, int]]:
        return list(zip(self.layers[:-1], self.layers[1:], strict=True))

    @property
    def size(self) -> int:
        return sum((a + 1) * b for a, b in self.shapes())

    def start(self, seed: int) -> np.ndarray:
        """Uniform weights scaled to the widths, zero offsets; a squared-loss output starts at zero."""
        rng, parts = np.random.default_rng(seed), []
        for k, (a, b) in enumerate(self.shapes()):
            bound = math.sqrt(6 / (a + b))
            weights = rng.uniform(-bound, bound, a * b)
            last = k == len(self.layers) - 2
            parts += [np.zeros(a * b) if last and self.loss == "squared" else weights, np.zeros(b)]
        return np.concatenate(parts)

    def _parts(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in self.shapes():
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + (a + 1) * b]))
            at += (a + 1) * b
        return out

    def forward(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Outputs of all layers, the last as probabilities or values."""
        parts, outs = self._parts(flat), [x]
        for k, (weights, offset) in enumerate(parts):
            z = outs[-1] @ weights + offset
            if k < len(parts) - 1:
                z = _UNITS[self.hidden](z)
            elif self.loss == "softmax":
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
            outs.append(z)
        return outs

    def errors(self, out: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Summed loss; summed hits (softmax) or absolute errors (squared)."""
        if self.loss == "softmax":
            own = out[np.arange(len(y)), y.astype(np.int64)]
            return float(-np.log(np.maximum(own, SMALLEST)).sum()), float((out.argmax(axis=1) == y).sum())
        miss = out[:, 0] - y
        return float((miss * miss).sum()), float(np.abs(miss).sum())

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
        """(summed gradient, summed loss, summed hits or absolute errors) of some rows."""
        outs, parts = self.forward(flat, x), self._parts(flat)
        if self.loss == "softmax":
            delta = outs[-1].copy()
            delta[np.arange(len(y)), y.astype(np.int64)] -= 1.0
        else:
            delta = 2.0 * (outs[-1] - y[:, None])
        found: list[np.ndarray] = []
        for k in range(len(parts) - 1, -1, -1):
            found = [(outs[k].T @ delta).ravel(), delta.sum(axis=0), *found]
            if k:
                delta = delta @ parts[k][0].T
                delta *= _SLOPES[self.hidden](outs[k])
        return np.concatenate(found), *self.errors(outs[-1], y)


@dataclass
class State:
    """Weights, Adam's moments, and the steps taken."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    @classmethod
    def new(cls, network: Network, seed: int) -> State:
        return cls(network.start(seed), np.zeros(network.size), np.zeros(network.size))

    def step(self, gradient: np.ndarray, rate: float) -> None:
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient * gradient
        scale = rate * math.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        self.weights = self.weights - scale * self.first / (np.sqrt(self.second) + 1e-7)

    def save(self, spark: SparkSession, path: str) -> None:
        row = [(self.steps, *(x.tobytes() for x in (self.weights, self.first, self.second)))]
        table = spark.createDataFrame(row, "steps bigint, weights binary, first binary, second binary")
        table.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> State:
        row = spark.read.parquet(path).first()
        return cls(*(np.frombuffer(bytes(row[c]), np.float64) for c in ("weights", "first", "second")), row["steps"])


def training_blocks(
    df: DataFrame,
    key: str,
    *,
    features: str = "features",
    label: str = "label",
    batch_rows: int = 4096,
    block_rows: int = 256,
    seed: int = 0,
    lane: int | None = None,
    whole: bool = True,
) -> tuple[DataFrame, int, int]:
    """(stored blocks by lane, batches, blocks); ``key`` is unique and decides the order with ``seed``.

    A lane is ``lane`` batches (LANE of them unless given), ``whole`` ones in one
    file and in order. Rows without a label or with a missing feature take no part.
    """
    rows = df.select(
        F.col(key), F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")
    ).where(F.col("y").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    n = rows.count()
    blocks = -(-n // block_rows)
    placed = shuffled_index(rows, key, seed=seed, n=n).withColumn("block", F.expr(f"pos div {block_rows}"))
    entry = F.struct("pos", "x", "y")
    gathered = placed.groupBy("block").agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    each = max(1, batch_rows // block_rows)
    batches = -(-blocks // each)
    stored = gathered.select(
        F.expr(f"block div {each * (lane or LANE)}").alias("lane"), F.expr(f"block div {each}").alias("batch"), "block",
        F.flatten("rows.x").alias("x"), F.col("rows.y").alias("y"),
    )
    path = scratch_path(df.sparkSession, "blocks")
    if whole:
        stored = stored.repartition("lane").sortWithinPartitions("lane", "block")
    # One row group a file: a scan never splits a lane.
    stored.write.partitionBy("lane").option("parquet.block.size", 256 << 20).parquet(path)
    return df.sparkSession.read.schema(stored.schema).parquet(path), batches, blocks


def _matrices(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for k, block in enumerate(batch.column("block").to_pylist()):
        x = batch.column("x")[k].values.to_numpy(zero_copy_only=False).reshape(-1, width)
        yield block, x, batch.column("y")[k].values.to_numpy(zero_copy_only=False)


_SUMS = "node bigint, gradient binary, loss double, hits double, n bigint"


def _sums(nodes: list, gradients: list, losses: list, hits: list, counts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array(gradients, pa.binary()), pa.array(losses, pa.float64()),
         pa.array(hits, pa.float64()), pa.array(counts, pa.int64())],
        ["node", "gradient", "loss", "hits", "n"],
    )


def _add(table: pa.Table) -> pa.Table:
    """One node of the tree: the sum of its entries in their order."""
    table = table.sort_by("node")
    gradient = sum(np.frombuffer(g, np.float64) for g in table["gradient"].to_pylist())
    sums = [math.fsum(table[c].to_pylist()) for c in ("loss", "hits")]
    node = table["up"][0].as_py()
    return pa.Table.from_batches([_sums([node], [gradient.tobytes()], *([s] for s in sums), [sum(table["n"].to_pylist())])])


def batch_gradient(
    blocks: DataFrame, count: int, network: Network, weights: np.ndarray
) -> tuple[np.ndarray, float, float, int]:
    """(summed gradient, loss, hits or errors, rows) over stored blocks numbered within ``count`` in a row."""
    held = blocks.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, x, y in _matrices(batch, network.layers[0]):
                gradient, loss, hits = network.gradient(held.value, x, y)
                yield _sums([block], [gradient.tobytes()], [loss], [hits], [len(y)])

    found = _summed(blocks.select("block", "x", "y").mapInArrow(work, _SUMS), count, network.size)
    held.unpersist()
    return found


def _summed(level: DataFrame, count: int, size: int) -> tuple[np.ndarray, float, float, int]:
    """The sums of ``count`` nodes numbered in a row, added in a tree."""
    while count > FAN_IN + 1:
        level = level.withColumn("up", F.expr(f"node div {FAN_IN}")).groupBy("up").applyInArrow(_add, _SUMS)
        count = -(-count // FAN_IN) + 1  # the first block need not begin a group
    rows = sorted(level.collect(), key=lambda r: r["node"])
    total = sum((np.frombuffer(bytes(r["gradient"]), np.float64) for r in rows), np.zeros(size))
    return total, math.fsum(r["loss"] for r in rows), math.fsum(r["hits"] for r in rows), sum(r["n"] for r in rows)


def lane_steps(
    blocks: DataFrame, lanes: int, first: int, network: Network, state: State, rate: float
) -> tuple[State, float, float, int]:
    """(state, loss, hits or errors, rows) after the steps of some stored lanes, taken side by side.

    ``lanes`` is their number, or that of all lanes where they are not numbered
    in a row, and ``first`` the blocks of a whole lane.
    """
    held = blocks.sparkSession.sparkContext.broadcast(state)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = batch = own = None
        gradient, step_rows, sums = None, 0, [0.0, 0.0, 0]

        def result() -> pa.RecordBatch:
            own.step(gradient / step_rows, rate)
            parts = np.concatenate([own.weights, own.first, own.second, [own.steps - held.value.steps]]) * sums[2]
            return _sums([lane], [parts.tobytes()], *([v] for v in sums))

        for rows in batches:
            places = rows.column("lane").to_pylist(), rows.column("batch").to_pylist()
            for at, (block, x, y) in enumerate(_matrices(rows, network.layers[0])):
                if places[0][at] != lane:
                    if lane is not None:
                        yield result()
                    lane, batch = places[0][at], places[1][at]
                    if block != lane * first:
                        raise RuntimeError(f"lane {lane} does not begin with its first block")
                    start = held.value
                    own = State(start.weights, start.first, start.second, start.steps)
                    gradient, step_rows, sums = np.zeros(network.size), 0, [0.0, 0.0, 0]
                elif places[1][at] != batch:
                    own.step(gradient / step_rows, rate)
                    batch, gradient, step_rows = places[1][at], np.zeros(network.size), 0
                found, loss, hits = network.gradient(own.weights, x, y)
                gradient, step_rows = gradient + found, step_rows + len(y)
                sums = [sums[0] + loss, sums[1] + hits, sums[2] + len(y)]
        if lane is not None:
            yield result()

    level = blocks.select("lane", "batch", "block", "x", "y").mapInArrow(work, _SUMS)
    total, loss, hits, n = _summed(level, lanes, 3 * network.size + 1)
    held.unpersist()
    mean = total / n
    weights, first_moment, second_moment = np.split(mean[:-1], 3)
    return State(weights, first_moment, second_moment, state.steps + round(mean[-1])), loss, hits, n


def chain_steps(
    blocks: DataFrame, order: Sequence[int], network: Network, state: State, rate: float
) -> tuple[State, float, float, int]:
    """(state, loss, hits or errors, rows) after the steps of some stored batches, one after the other in ``order``.

    One task takes them all, so ``order`` should be short; its length changes no bit of the result.
    """
    held = blocks.sparkSession.sparkContext.broadcast(state)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, batch, sums = held.value, None, [0.0, 0.0, 0]
        own = State(start.weights, start.first, start.second, start.steps)
        gradient, step_rows = np.zeros(network.size), 0
        for rows in batches:
            places = rows.column("batch").to_pylist()
            for at, (_, x, y) in enumerate(_matrices(rows, network.layers[0])):
                if places[at] != batch:
                    if batch is not None:
                        own.step(gradient / step_rows, rate)
                    batch, gradient, step_rows = places[at], np.zeros(network.size), 0
                found, loss, hits = network.gradient(own.weights, x, y)
                gradient, step_rows = gradient + found, step_rows + len(y)
                sums = [sums[0] + loss, sums[1] + hits, sums[2] + len(y)]
        if batch is not None:
            own.step(gradient / step_rows, rate)
        parts = np.concatenate([own.weights, own.first, own.second])
        yield _sums([own.steps], [parts.tobytes()], *([v] for v in sums))

    place = F.array_position(F.array(*map(F.lit, order)), F.col("batch"))
    chosen = blocks.where(F.col("lane").isin(list(order))).select(place.alias("place"), "batch", "block", "x", "y")
    row = chosen.coalesce(1).sortWithinPartitions("place", "block").mapInArrow(work, _SUMS).first()
    held.unpersist()
    weights, first, second = np.split(np.frombuffer(bytes(row["gradient"]), np.float64), 3)
    return State(weights, first, second, row["node"]), row["loss"], row["hits"], row["n"]


def packed_rows(df: DataFrame, network: Network, features: str, label: str) -> DataFrame:
    """(x, y): each partition's rows in blocks of ``PACKED_ROWS``, the last one shorter, numbers packed.

    A missing value, another number of features or a label that is no class is an error.
    """
    width, classes = network.layers[0], network.layers[-1]

    def blocks(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        starts = range(0, len(y), PACKED_ROWS)
        columns = [pa.array([v[k : k + PACKED_ROWS].tobytes() for k in starts], pa.binary()) for v in (x, y)]
        return pa.RecordBatch.from_arrays(columns, ["x", "y"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_x, left_y = np.zeros((0, width)), np.zeros(0)
        for batch in batches:
            x, y = batch.columns
            if x.null_count or y.null_count or len(set(x.value_lengths().to_pylist()) - {width}):
                raise ValueError(f"features must be {width} numbers and labels must not be null")
            x, y = x.flatten(), y.to_numpy(zero_copy_only=False)
            if x.null_count or not ((y >= 0) & (y < classes) & (y == np.floor(y))).all():
                raise ValueError(f"features must not be null and labels must be whole numbers below {classes}")
            x = np.concatenate([left_x, x.to_numpy(zero_copy_only=False).reshape(-1, width)])
            y = np.concatenate([left_y, y])
            full = len(y) - len(y) % PACKED_ROWS
            left_x, left_y = x[full:], y[full:]
            yield blocks(x[:full], y[:full])
        yield blocks(left_x, left_y)

    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))
    return rows.mapInArrow(work, "x binary, y binary")


def whole_gradient(packed: DataFrame, tasks: int, network: Network, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """(loss, its gradient), both the mean of the blocks' means, of packed rows in ``tasks`` partitions.

    A task sends one sum.
    """
    held = packed.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, sums = np.zeros(network.size), [0.0, 0.0, 0]
        for batch in batches:
            for own in zip(*(batch.column(c) for c in ("x", "y")), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.float64) for v in own)
                found, loss, hits = network.gradient(held.value, x.reshape(len(y), -1), y)
                gradient += found / len(y)
                sums = [sums[0] + loss / len(y), sums[1] + hits, sums[2] + 1]
        yield _sums([TaskContext.get().partitionId()], [gradient.tobytes()], *([v] for v in sums))

    total, loss, _, n = _summed(packed.select("x", "y").mapInArrow(work, _SUMS), tasks, network.size)
    held.unpersist()
    return loss / n, total / n


def fit_whole(
    df: DataFrame, network: Network, start: np.ndarray, max_iter: int, *, features: str, label: str
) -> np.ndarray:
    """Weights after ``max_iter`` quasi-Newton steps at most on the loss of all rows.

    Rows are packed once, and their blocks dealt out evenly, whatever the layout of ``df``.
    """
    packed = packed_rows(df, network, features, label).persist(StorageLevel.MEMORY_AND_DISK)
    dealt = None
    try:
        size = packed.agg(F.sum(F.octet_length("x") + F.octet_length("y")).alias("size")).first()["size"]
        if not size:
            raise ValueError("no rows to learn from")
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
        dealt = packed.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
        dealt.count()
        packed.unpersist()
        return minimize(lambda w: whole_gradient(dealt, tasks, network, w), start, max_iter)
    finally:
        packed.unpersist()
        if dealt is not None:
            dealt.unpersist()


def evaluate(blocks: DataFrame, network: Network, weights: np.ndarray) -> tuple[float, float]:
    """(mean loss, accuracy or mean absolute error) over blocks; not a number without rows."""
    held = blocks.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = hits = n = 0.0
        for batch in batches:
            for _, x, y in _matrices(batch, network.layers[0]):
                a, b = network.errors(network.forward(held.value, x)[-1], y)
                loss, hits, n = loss + a, hits + b, n + len(y)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (loss, hits, n)], ["loss", "hits", "n"])

    sums = blocks.select("block", "x", "y").mapInArrow(work, "loss double, hits double, n double")
    row = sums.agg(F.sum("loss").alias("loss"), F.sum("hits").alias("hits"), F.sum("n").alias("n")).first()
    return (row["loss"] / row["n"], row["hits"] / row["n"]) if row["n"] else (math.nan, math.nan)


def predict(df: DataFrame, network: Network, weights: np.ndarray, features: str = "features") -> DataFrame:
    """``df`` with ``prediction``: the likeliest class or the value; null where a feature is missing."""
    held = df.sparkSession.sparkContext.broadcast(weights)
    inside = df.withColumn("_x", F.col(features).cast("array<double>"))
    whole = F.col("_x").isNotNull() & F.forall("_x", lambda v: v.isNotNull()) & (F.size("_x") == network.layers[0])

    @F.pandas_udf("double")
    def guess(x):
        out = network.forward(held.value, np.stack(x.to_numpy()) if len(x) else np.zeros((0, network.layers[0])))[-1]
        import pandas as pd

        return pd.Series(out.argmax(axis=1).astype(float) if network.loss == "softmax" else out[:, 0])

    zeros = F.array_repeat(F.lit(0.0), network.layers[0])
    filled = inside.withColumn("_ok", F.coalesce(whole, F.lit(False)))
    return filled.withColumn(
        "prediction", F.when(F.col("_ok"), guess(F.when(F.col("_ok"), F.col("_x")).otherwise(zeros)))
    ).drop("_x", "_ok")


def fit_with_checkpoints(
    train: DataFrame,
    validation: DataFrame,
    network: Network,
    *,
    key: str,
    run_id: str,
    store: str,
    ledger: str,
    max_epochs: int = 10,
    rate: float = 1.0,
    learning_rate: float = 1e-3,
    batch_rows: int = 4096,
    block_rows: int = 256,
    seed: int = 0,
    features: str = "features",
    label: str = "label",
    chained: bool = False,
    on_epoch: Callable[[int, dict[str, float]], None] | None = None,
) -> State:
    """Train epoch by epoch; each epoch stores its state and a ledger row.

    A run whose last row says recovery goes on from int(epochs * rate) with the
    newest state; with ``rate`` 1 its weights are those of a run without the
    interruption. A finished run gets a closing row with recovery = false.
    Metrics are means over the epoch's steps (train) and after it (``val_``).
    With ``chained`` every batch steps from the weights of the one before it, else
    batches stand in lanes; which of the two does not depend on the rows.
    ``on_epoch`` runs on the driver between epochs.
    """
    spark = train.sparkSession
    rows = ledger_rows(spark, ledger)
    at = resume_point(ledger_read(rows, spark.createDataFrame([(run_id,)], "run_id string")), rate).first()
    state, seq = State.new(network, seed), at["seq"]
    if at["recovery"]:
        newest = latest_checkpoint(rows.filter(F.col("run_id") == run_id)).first()
        if newest is not None:
            state = State.load(spark, model_path(store, run_id, newest["epoch"]))
    options = {"features": features, "label": label, "batch_rows": batch_rows, "block_rows": block_rows, "seed": seed}
    each, batch_bytes = max(1, batch_rows // block_rows), 8 * batch_rows * network.layers[0]
    link = CHAIN_BYTES // batch_bytes  # batches of a job, none where its tasks share one batch
    blocks, batches, _ = training_blocks(train, key, **options, lane=1 if chained else None, whole=not chained or link > 0)
    lanes = batches if chained else -(-batches // LANE)
    held, *_ = training_blocks(validation, key, **options)
    names = ("loss", "accuracy" if network.loss == "softmax" else "mae")
    for epoch in range(at["resume_epoch"] + 1, max_epochs + 1):
        sums = np.zeros(3)
        order = np.random.default_rng([seed, epoch]).permutation(lanes)
        for own in [] if chained else np.array_split(order, max(1, min(ROUNDS, lanes))):
            if len(own):
                count = lanes if len(own) > FAN_IN else len(own)
                chosen = blocks.where(F.col("lane").isin(own.tolist()))
                state, *found = lane_steps(chosen, count, each * LANE, network, state, learning_rate)
                sums += found
        for at in range(0, lanes, max(1, link)) if chained else []:
            own = order[at : at + max(1, link)].tolist()
            if link:
                state, *found = chain_steps(blocks, own, network, state, learning_rate)
            else:
                gradient, *found = batch_gradient(blocks.where(F.col("lane") == own[0]), each, network, state.weights)
                state.step(gradient / found[2], learning_rate)
            sums += found
        metrics = dict(zip(names, (sums[:2] / max(sums[2], 1)).tolist(), strict=True))
        metrics |= {f"val_{name}": x for name, x in zip(names, evaluate(held, network, state.weights), strict=True)}
        state.save(spark, model_path(store, run_id, epoch))
        seq += 1
        ledger_append(ledger_entry(spark, run_id, seq, epoch, max_epochs, True, metrics), ledger)
        if on_epoch is not None:
            on_epoch(epoch, metrics)
    ledger_append(ledger_entry(spark, run_id, seq + 1, max_epochs, max_epochs, False), ledger)
    return state


def forecast_inputs(windows: DataFrame) -> DataFrame:
    """Window slices with flat ``features`` and the next value as ``label``."""
    return windows.withColumns({"features": F.flatten("inputs"), "label": F.col("labels")[0][0]}).drop("inputs", "labels")


def forecaster(inputs: int, units: int = 32) -> Network:
    """A squared-loss network over a flat window."""
    return Network((inputs, units, 1), hidden="tanh", loss="squared")


def classifier(layers: Sequence[int]) -> Network:
    """A softmax network with rectified hidden units."""
    return Network(tuple(layers))

"""k-means over dense vectors: every number of clusters and every start in the same scans.

A scan goes over Arrow blocks of the stored points; one matrix product gives the
distances to the centres of all fits that still move, and each task sends sums
per centre. Centres (the sum of all k times the dimension) are what the driver
and the tasks hold. Distances are computed anew in each scan: bounds per point
and fit that would spare some of them are larger than the points themselves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmetrics.session import materialize, spread

#: Squared distances below this share of the two lengths are rounding.
ROUNDING = 1e-12
#: Rows worked on at once, which bounds the distance matrix.
ROWS = 4096
U = np.uint64


@dataclass
class Fit:
    """One run: its centres (k rows), the sum of squared distances, and the scans it took."""

    centres: np.ndarray
    inertia: float = float("inf")
    scans: int = 0


def stored_points(df: DataFrame, features: str = "features", key: str | None = None) -> DataFrame:
    """(x, h) written once: vectors and a hash of the key, or of the row's place, for draws."""
    place = F.col(key) if key is not None else F.monotonically_increasing_id()
    points = df.select(F.col(features).cast("array<double>").alias("x"), F.xxhash64(place).alias("h"))
    return spread(materialize(points.where(F.col("x").isNotNull()), "points"))


def packed_points(points: DataFrame) -> DataFrame:
    """:func:`stored_points` as blocks of ROWS points, two buffers each, so that a scan converts no number."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, h in _blocks(batches):
            both = [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (x, h)]
            yield pa.RecordBatch.from_arrays(both, ["x", "h"])

    return spread(materialize(points.mapInArrow(pack, "x binary, h binary"), "blocks"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows and pa.types.is_binary(batch.schema.field("x").type):
            for x, h in zip(batch.column("x"), batch.column("h"), strict=True):
                hashes = np.frombuffer(h.as_buffer(), np.int64)
                yield np.frombuffer(x.as_buffer()).reshape(len(hashes), -1), hashes
            continue
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            x = part.column("x")
            yield x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), part.column("h").to_numpy()


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    both = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None]
    found = both - 2 * (x @ centres.T)
    found[found <= both * ROUNDING] = 0.0
    return found


def uniform(h: np.ndarray, seed: int, step: int) -> np.ndarray:
    """Numbers between 0 and 1 from hashes, another for each seed and step."""
    with np.errstate(over="ignore"):
        x = h.astype(np.int64).view(U) + U(seed * 1_000_003 + step + 1) * U(0x9E3779B97F4A7C15)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> U(shift))) * U(by)
    return ((x ^ (x >> U(31))) >> U(12)).astype(np.float64) / (1 << 52) + 2.0**-54


def seed_centres(points: DataFrame, ks: Sequence[int], seeds: Sequence[int]) -> list[np.ndarray]:
    """Centres for each fit, drawn one after the other by squared distance to the nearest drawn.

    One scan per step draws for all fits: the least exponential draw wins. A fit
    whose points all lie on its centres gets no more of them.
    """
    picked: list[list[np.ndarray]] = [[] for _ in ks]
    open_ = list(range(len(ks)))
    for step in range(max(ks, default=0)):
        open_ = [f for f in open_ if ks[f] > step]
        held = points.sparkSession.sparkContext.broadcast([(f, seeds[f], picked[f]) for f in open_])

        def draw(batches: Iterator[pa.RecordBatch], held=held, step=step) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, np.ndarray]] = {}
            for x, h in _blocks(batches):
                for f, seed, own in held.value:
                    near = squared_distances(x, np.array(own)).min(axis=1) if own else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        race = -np.log(uniform(h, seed, step)) / near
                    at = int(race.argmin())
                    if np.isfinite(race[at]) and (f not in best or race[at] < best[f][0]):
                        best[f] = (float(race[at]), x[at].copy())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(best), pa.int32()), pa.array([b[0] for b in best.values()], pa.float64()),
                 pa.array([b[1].tolist() for b in best.values()], pa.list_(pa.float64()))],
                ["fit", "race", "x"],
            )

        drawn = points.mapInArrow(draw, "fit int, race double, x array<double>")
        found = {r["fit"]: np.array(r["x"]) for r in drawn.groupBy("fit").agg(F.min_by("x", "race").alias("x")).collect()}
        open_ = [f for f in open_ if f in found]
        for f in open_:
            picked[f].append(found[f])
    return [np.array(p) for p in picked]


def _sums(points: DataFrame, fits: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One scan: for each fit the points, their summed vectors and squared distances by centre."""
    order = list(fits)
    stack = np.concatenate([fits[f] for f in order])
    ends = np.cumsum([0, *(len(fits[f]) for f in order)])
    held = points.sparkSession.sparkContext.broadcast((stack, ends))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, ends = held.value
        n, cost, total = np.zeros(len(stack), np.int64), np.zeros(len(stack)), np.zeros(stack.shape)
        for x, _ in _blocks(batches):
            distance = squared_distances(x, stack)
            member, every = np.zeros((len(x), len(stack))), np.arange(len(x))
            for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                nearest = begin + distance[:, begin:end].argmin(axis=1)
                member[every, nearest] = 1.0
                n += np.bincount(nearest, minlength=len(stack))
                cost += np.bincount(nearest, distance[every, nearest], len(stack))
            total += member.T @ x
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(n[used]), pa.array(cost[used]),
             pa.array(total[used].tolist(), pa.list_(pa.float64()))],
            ["centre", "n", "cost", "total"],
        )

    rows = points.mapInArrow(add, "centre int, n bigint, cost double, total array<double>")
    summed = rows.groupBy("centre").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"), Summarizer.sum(array_to_vector("total")).alias("total")
    )
    n, cost, total = np.zeros(len(stack), np.int64), np.zeros(len(stack)), np.zeros(stack.shape)
    for r in summed.select("centre", "n", "cost", vector_to_array("total").alias("total")).collect():
        n[r["centre"]], cost[r["centre"]], total[r["centre"]] = r["n"], r["cost"], r["total"]
    return {f: (n[a:b], total[a:b], cost[a:b]) for f, a, b in zip(order, ends[:-1], ends[1:], strict=True)}


def lloyd(points: DataFrame, starts: Sequence[np.ndarray], max_iter: int = 300) -> list[Fit]:
    """Lloyd's algorithm for every start at once; a start leaves the scans when its centres rest.

    Centres without points stay where they are. A start ends when no centre
    moves, its sum no longer falls, or after ``max_iter`` scans.
    """
    fits = [Fit(np.array(s, float)) for s in starts]
    moving = [f for f, fit in enumerate(fits) if len(fit.centres)]
    for scan in range(1, max_iter + 1):
        if not moving:
            break
        going = []
        for f, (n, total, cost) in _sums(points, {f: fits[f].centres for f in moving}).items():
            fit, inertia = fits[f], float(cost.sum())
            means = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], fit.centres)
            rests = not inertia < fit.inertia or np.array_equal(means, fit.centres) or scan == max_iter
            fit.inertia, fit.scans = min(inertia, fit.inertia), scan
            if not rests:
                fit.centres = means
                going.append(f)
        moving = going
    return fits


def fit_all(
    points: DataFrame, ks: Sequence[int], starts: int = 10, seed: int = 0, max_iter: int = 300
) -> dict[int, Fit]:
    """The best of ``starts`` fits for each k, all in the same scans of :func:`stored_points`."""
    points = packed_points(points)
    plan = [(k, seed + s) for k in ks for s in range(starts if k > 1 else 1)]
    fits = lloyd(points, seed_centres(points, [k for k, _ in plan], [s for _, s in plan]), max_iter)
    best: dict[int, Fit] = {}
    for (k, _), fit in zip(plan, fits, strict=True):
        if k not in best or fit.inertia < best[k].inertia:
            best[k] = fit
    return best

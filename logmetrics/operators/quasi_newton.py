"""Limited-memory BFGS with a strong Wolfe line search (Nocedal and Wright 2006, chapters 3 and 7).

The driver holds ``MEMORY`` pairs of vectors as long as the weights; ``loss`` does the work on
the rows. Memory, line search and ends are those of Spark's own perceptron.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: Steps kept, losses looked back on, and tries of a line search.
MEMORY, LOOK_BACK, TRIES = 10, 20, 10
SUFFICIENT, CURVATURE = 1e-4, 0.9

Loss = Callable[[np.ndarray], tuple[float, np.ndarray]]


class SearchFailed(ArithmeticError):
    """No step was found along a direction."""


def minimize(loss: Loss, start: np.ndarray, max_iter: int, tolerance: float = 1e-6) -> np.ndarray:
    """Weights after at most ``max_iter`` steps, fewer once losses or gradients rest.

    After a failed search the memory is emptied once; a second failure ends.
    """
    x, (value, slope) = start, loss(start)
    first, seen, memory, failed, steps = value, [value], [], False, 0
    while steps < max_iter and np.linalg.norm(slope) > max(tolerance * value, 1e-8):
        if len(seen) > 1 and abs(value - max(seen[-LOOK_BACK:])) <= tolerance * first:
            break
        direction = _direction(slope, memory)
        try:
            length = 1.0 if steps else 1.0 / np.linalg.norm(direction)
            moved, value_there, slope_there = _search(loss, x, direction, value, slope, length)
        except SearchFailed:
            if failed:
                break
            failed, memory = True, []
            continue
        memory = [(moved - x, slope_there - slope), *memory][:MEMORY]
        x, value, slope, steps = moved, value_there, slope_there, steps + 1
        seen.append(value)
    return x


def _direction(slope: np.ndarray, memory: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out, shares = -slope, []
    for step, change in memory:
        share = (step @ out) / (step @ change)
        out = out - share * change
        shares.append(share)
    if memory:
        step, change = memory[0]
        out = out * ((step @ change) / (change @ change))
    for (step, change), share in zip(reversed(memory), reversed(shares), strict=True):
        out = out + step * (share - (change @ out) / (step @ change))
    return out


def _search(
    loss: Loss, x: np.ndarray, direction: np.ndarray, value: float, slope: np.ndarray, t: float
) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, loss, gradient) at a length along ``direction`` that meets both Wolfe conditions."""
    found: dict[float, tuple[np.ndarray, float, np.ndarray]] = {}

    def at(length: float) -> tuple[float, float, float]:
        there = x + direction * length
        found[length] = there, *loss(there)
        return length, found[length][1], float(found[length][2] @ direction)

    low = (0.0, value, float(slope @ direction))
    fall = low[2]
    if not fall <= 0:
        raise SearchFailed("no descent")

    def zoom(low: tuple, high: tuple) -> tuple[np.ndarray, float, np.ndarray]:
        for _ in range(TRIES):
            c = at(_between(*sorted((low, high))))
            if c[1] > value + SUFFICIENT * c[0] * fall or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= CURVATURE * abs(fall):
                    return found[c[0]]
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise SearchFailed("zoom")

    for k in range(TRIES):
        c = at(t)
        if not math.isfinite(c[1]):
            t /= 2.0
            continue
        if c[1] > value + SUFFICIENT * t * fall or (c[1] >= low[1] and k > 0):
            return zoom(low, c)
        if abs(c[2]) <= CURVATURE * abs(fall):
            return found[c[0]]
        if c[2] >= 0:
            return zoom(c, low)
        low = c
        t *= 1.5
    raise SearchFailed("length")


def _between(left: tuple, right: tuple) -> float:
    """Least point of the cubic through two lengths with losses and slopes, off both ends."""
    (a, fa, da), (b, fb, db) = left, right
    one = da + db - 3 * (fa - fb) / (a - b)
    two = math.sqrt(max(one * one - da * db, 0.0))
    t = b - (b - a) * (db + two - one) / ((db - da + 2 * two) or math.nan)
    low, high = a + 0.1 * (b - a), a + 0.9 * (b - a)
    return (a + b) / 2 if math.isnan(t) else min(max(t, low), high)

"""One random tree in numpy: the per-task helpers of the two forests."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Fixed value: Euler's constant, in the mean path length of a random search tree.
EULER_GAMMA = 0.5772156649015329


@dataclass
class Tree:
    """Nodes in parent-before-child order; -1 where there is no node or cut."""

    parent: np.ndarray
    left: np.ndarray
    right: np.ndarray
    dim: np.ndarray
    cut: np.ndarray
    n: np.ndarray
    leaf: np.ndarray | None = None  # leaf node of each input row
    points: np.ndarray | None = None  # leaf nodes' points, by node

    def to_arrow(self, tree: int) -> pa.Table:
        leaves = self.left < 0
        size = len(self.parent)
        columns = {
            "tree": pa.array(np.full(size, tree, dtype=np.int64)),
            "node": pa.array(np.arange(size, dtype=np.int32)),
            "parent": pa.array(self.parent),
            "left": pa.array(self.left),
            "right": pa.array(self.right),
            "dim": pa.array(self.dim),
            "cut": pa.array(self.cut, mask=leaves),
            "n": pa.array(self.n),
        }
        if self.points is not None:
            held = [p if leaf else None for p, leaf in zip(self.points, leaves, strict=True)]
            columns["point"] = pa.array(held, type=pa.list_(pa.float64()))
        return pa.table(columns)


def _grow(points, weights, choose, max_depth=None):
    """Split ``points`` level by level.

    All nodes of a level are split in one step: their points lie side by side,
    ranges are segmented minima and maxima, and ``choose(low, high)`` gives the
    dimension and cut of every node at once (dimension -1: no split). Nodes are
    numbered by level, in order, the low side first.
    """
    size = len(points)
    parent, left, right, dim, cut, n = (np.empty(2 * size, t) for t in "iiiidq")
    leaf_of = np.empty(size, dtype=np.int32)
    order, starts = np.arange(size), np.zeros(min(size, 1), dtype=np.int64)
    nodes, parent[0], made, depth = np.zeros(min(size, 1), dtype=np.int32), -1, min(size, 1), 0
    while len(nodes):
        ends = np.append(starts[1:], len(order))
        n[nodes] = np.add.reduceat(weights[order], starts)
        held = points[order]
        dims = np.full(len(nodes), -1, dtype=np.int32)
        wide = np.flatnonzero(ends - starts > 1)
        if len(wide) and (max_depth is None or depth < max_depth):
            low, high = (f.reduceat(held, starts, axis=0)[wide] for f in (np.minimum, np.maximum))
            dims[wide], cuts = choose(low, high)
        else:
            cuts = np.zeros(len(wide))
        all_cuts = np.zeros(len(nodes))
        all_cuts[wide] = cuts
        split = dims >= 0
        dim[nodes], cut[nodes] = dims, np.where(split, all_cuts, 0.0)
        left[nodes] = right[nodes] = -1
        segment = np.repeat(np.arange(len(nodes)), ends - starts)
        stay = ~split[segment]
        leaf_of[order[stay]] = nodes[segment[stay]]
        order, segment, held = order[~stay], segment[~stay], held[~stay]
        side = held[np.arange(len(order)), dims[segment]] > all_cuts[segment]
        place = np.cumsum(split) - 1  # of the split nodes among themselves
        child = 2 * place[segment] + side
        order = order[np.argsort(child, kind="stable")]
        above = nodes[split]
        nodes = made + np.arange(2 * len(above), dtype=np.int32)
        left[above], right[above] = nodes[::2], nodes[1::2]
        parent[nodes] = np.repeat(above, 2)
        counts = np.bincount(child, minlength=len(nodes))
        starts = np.cumsum(counts) - counts
        made += len(nodes)
        depth += 1
    arrays = [a[:made].copy() for a in (parent, left, right, dim, cut, n)]
    return Tree(*arrays), leaf_of


def _levels(tree: Tree):
    """(split nodes, their low children, their high children) of each level, from the root."""
    nodes = np.zeros(min(len(tree.n), 1), dtype=np.int64)
    while len(nodes):
        nodes = nodes[tree.left[nodes] >= 0]
        if len(nodes):
            yield nodes, tree.left[nodes], tree.right[nodes]
        nodes = np.concatenate([tree.left[nodes], tree.right[nodes]])


def cut_tree(points: np.ndarray, rng: np.random.Generator) -> Tree:
    """Random cut tree. Equal points are merged first, which also makes the
    draws independent of the order in which rows arrive."""
    distinct, inverse, counts = np.unique(points, axis=0, return_inverse=True, return_counts=True)

    def choose(low, high):
        every = np.arange(len(low))
        edges = np.cumsum(high - low, axis=1)
        draw = rng.random(len(low)) * edges[:, -1]
        dim = np.minimum((edges <= draw[:, None]).sum(axis=1), low.shape[1] - 1)
        before = np.where(dim > 0, edges[every, dim - 1], 0.0)
        cut = low[every, dim] + (draw - before)
        # Rounding at the ends of the range.
        out = ~((low[every, dim] <= cut) & (cut < high[every, dim]))
        dim[out] = np.argmax(high[out] - low[out], axis=1)
        cut[out] = low[out, dim[out]]
        return dim, cut

    tree, leaf_of = _grow(distinct, counts, choose)
    tree.leaf = leaf_of[inverse.reshape(-1)]
    held = np.full((len(tree.n), points.shape[1]), np.nan)
    held[leaf_of] = distinct
    tree.points = held
    return tree


def _best_ratio(tree: Tree, joined: int) -> np.ndarray:
    """Per node the largest sibling / own ratio on the way from the root, with
    ``joined`` extra points in the own branch."""
    best = np.zeros(len(tree.n))
    for above, low, high in _levels(tree):
        best[low] = np.maximum(best[above], tree.n[high] / (tree.n[low] + joined))
        best[high] = np.maximum(best[above], tree.n[low] / (tree.n[high] + joined))
    return best


def displacements(tree: Tree) -> np.ndarray:
    """Collusive displacement of each input row; 0 when all rows are equal."""
    return _best_ratio(tree, 0)[tree.leaf]


def insertion_scores(tree: Tree, points: np.ndarray) -> np.ndarray:
    """Expected collusive displacement of each row if inserted alone."""
    low, high = _boxes(tree)
    best = _best_ratio(tree, 1)
    sizes = (high - low).sum(axis=1)
    scores = np.zeros(len(points))
    todo = [(0, np.arange(len(points)), np.ones(len(points)))]
    while todo:
        node, rows, reach = todo.pop()
        if not len(rows):
            continue
        here = points[rows]
        side = here[:, tree.dim[node]] <= tree.cut[node]
        # What lies outside of the box, in the gathered rows' own memory.
        here -= np.clip(here, low[node], high[node])
        growth = np.abs(here, out=here).sum(axis=1)
        grown = growth + sizes[node]
        apart = np.divide(growth, grown, out=np.zeros_like(growth), where=grown > 0)
        scores[rows] += reach * apart * max(float(tree.n[node]), best[node])
        stays = reach * (1 - apart)
        if tree.left[node] < 0:
            scores[rows] += stays * best[node]
            continue
        todo.append((tree.left[node], rows[side], stays[side]))
        todo.append((tree.right[node], rows[~side], stays[~side]))
    return scores


def _boxes(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    low, high = tree.points.copy(), tree.points.copy()
    for above, a, b in reversed(list(_levels(tree))):
        low[above] = np.minimum(low[a], low[b])
        high[above] = np.maximum(high[a], high[b])
    return low, high


def isolation_tree(points: np.ndarray, rng: np.random.Generator) -> Tree:
    """Isolation tree: a uniformly drawn non-constant dimension, a uniform cut,
    depth at most ceil(log2(sample))."""

    def choose(low, high):
        every = np.arange(len(low))
        varying = high > low
        ranks = np.cumsum(varying, axis=1)
        wanted = (rng.random(len(low)) * ranks[:, -1]).astype(np.int64) + 1
        dim = np.where(ranks[:, -1] > 0, (ranks < wanted[:, None]).sum(axis=1), -1)
        least, most = low[every, dim], high[every, dim]
        cut = least + rng.random(len(low)) * (most - least)
        return dim, np.where(cut < most, cut, least)

    depth = int(np.ceil(np.log2(max(len(points), 2))))
    tree, _ = _grow(points, np.ones(len(points), dtype=np.int64), choose, depth)
    return tree


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean unsuccessful-search path length c(n): 0, 0, 1, then the closed form."""
    size = np.asarray(n, dtype=np.float64)
    out = np.where(size == 2, 1.0, 0.0)
    big = size > 2
    m = size[big]
    out[big] = 2.0 * (np.log(m - 1.0) + EULER_GAMMA) - 2.0 * (m - 1.0) / m
    return out


def isolation_depths(tree: Tree, points: np.ndarray) -> np.ndarray:
    """Path length of each row: edges to its leaf plus c(leaf size).

    All rows go down together, level by level; a row at its leaf stays there.
    """
    leaf, own = tree.left < 0, np.arange(len(tree.n))
    # The way right and left of each node; what is not at or below the cut, such as NaN, goes right.
    ways = np.stack([np.where(leaf, own, tree.right), np.where(leaf, own, tree.left)], axis=1).reshape(-1)
    dim, depth, levels = np.where(leaf, 0, tree.dim).astype(np.int64), np.zeros(len(own)), 0
    for above, low, high in _levels(tree):
        depth[low] = depth[high] = depth[above] + 1
        levels += 1
    at = np.zeros(len(points), dtype=np.int64)
    if levels:
        flat, begin = points.reshape(-1), np.arange(len(points)) * points.shape[1]
        for _ in range(levels):
            value = flat.take(begin + dim.take(at))
            at = ways.take(2 * at + (value <= tree.cut.take(at)))
    return (depth + mean_path(tree.n)).take(at)

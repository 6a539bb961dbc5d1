import numpy as np
import pytest

from logmetrics.operators import trees as tr


def naive(points, weights, pick, draws, rng, max_depth=None):
    """The same trees, node by node: a level's draws are taken together, nodes follow in order."""
    nodes, level, depth = [], [(np.arange(len(points)), -1)], 0
    while level:
        wide = [k for k, (own, _) in enumerate(level) if len(own) > 1]
        if not wide or (max_depth is not None and depth >= max_depth):
            wide = []
        numbers = dict(zip(wide, zip(*(rng.random(len(wide)) for _ in range(draws)))))
        following = []
        for k, (own, above) in enumerate(level):
            split = pick(points[own], *numbers[k]) if k in numbers else None
            node = {"parent": above, "n": int(weights[own].sum()), "split": split, "own": own}
            at = len(nodes)
            nodes.append(node)
            if split is not None:
                low = points[own, split[0]] <= split[1]
                following += [(own[low], at), (own[~low], at)]
        level, depth = following, depth + 1
    return nodes


def by_range(block, draw):
    low, high = block.min(axis=0), block.max(axis=0)
    edges = np.cumsum(high - low)
    at = draw * edges[-1]
    dim = min(int(np.searchsorted(edges, at, side="right")), len(edges) - 1)
    cut = low[dim] + (at - (edges[dim - 1] if dim else 0.0))
    if not low[dim] <= cut < high[dim]:
        dim = int(np.argmax(high - low))
        cut = low[dim]
    return dim, float(cut)


def by_dimension(block, first, second):
    low, high = block.min(axis=0), block.max(axis=0)
    varying = np.flatnonzero(high > low)
    if not len(varying):
        return None
    dim = int(varying[int(first * len(varying))])
    cut = low[dim] + second * (high[dim] - low[dim])
    return dim, float(cut if cut < high[dim] else low[dim])


def samples():
    draw = np.random.default_rng(0)
    yield draw.normal(size=(64, 3))
    yield draw.integers(0, 3, (80, 2)).astype(float)
    yield np.ones((5, 2))
    yield draw.normal(size=(1, 4))
    yield np.r_[draw.normal(size=(20, 1)), [[1e12]], [[-1e-300]]]


@pytest.mark.parametrize("points", list(samples()))
def test_levels_give_the_naive_trees(points):
    distinct, counts = np.unique(points, axis=0, return_counts=True)
    want = naive(distinct, counts, by_range, 1, np.random.default_rng(5))
    tree = tr.cut_tree(points, np.random.default_rng(5))
    check(tree, want)
    assert [tree.n[leaf] for leaf in tree.leaf] == [counts[(distinct == p).all(axis=1)][0] for p in points]
    assert (tree.points[tree.leaf] == points).all()
    depth = int(np.ceil(np.log2(max(len(points), 2))))
    want = naive(points, np.ones(len(points), int), by_dimension, 2, np.random.default_rng(6), depth)
    check(tr.isolation_tree(points, np.random.default_rng(6)), want)


def check(tree, want):
    assert tree.parent.tolist() == [n["parent"] for n in want]
    assert tree.n.tolist() == [n["n"] for n in want]
    assert [(d, c) if d >= 0 else None for d, c in zip(tree.dim.tolist(), tree.cut.tolist())] == [n["split"] for n in want]


def test_ratios_and_boxes_by_level():
    points = np.random.default_rng(2).normal(size=(50, 3))
    tree = tr.cut_tree(points, np.random.default_rng(3))
    for joined in (0, 1):
        best = np.zeros(len(tree.n))
        for node in range(1, len(tree.n)):
            above = tree.parent[node]
            other = tree.right[above] if tree.left[above] == node else tree.left[above]
            best[node] = max(best[above], tree.n[other] / (tree.n[node] + joined))
        assert (tr._best_ratio(tree, joined) == best).all()
    low, high = tr._boxes(tree)
    assert (low[0] == points.min(axis=0)).all() and (high[0] == points.max(axis=0)).all()

"""Regression trees over binned inputs, fitted on one bag of rows inside a task.

A panel of many series is dealt into bags by Spark; a bag has a bounded number of rows, so its trees are fitted
in one task with array passes, and bags of all folds side by side. The nodes of a fitted tree are few (they follow from depth or
leaves, not from the data), so they are gathered and sent to the tasks that predict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bins of one input at most.
BINS = 64

#: Leaves of a tree whose nodes are all asked at once: one bit each. For a number with one bit, which bit that is.
LEAVES = 16
FIRST = np.zeros(1 << LEAVES, np.int64)
FIRST[1 << np.arange(LEAVES)] = np.arange(LEAVES)

#: Bits that hold the number of a threshold.
SHIFT = 32

#: Elements that one array pass of a prediction holds at most: few enough for a core's own cache.
PASS = 24_000


@dataclass
class Tree:
    """Nodes in arrays: at a leaf the threshold is infinite and both children are the leaf itself."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    @staticmethod
    def root(value: float) -> Tree:
        tree = Tree([], [], [], [], [])
        tree.leaf(value)
        return tree

    def leaf(self, value: float) -> int:
        n = len(self.value)
        self.feature.append(0)
        self.threshold.append(float("inf"))
        self.left.append(n)
        self.right.append(n)
        self.value.append(float(value))
        return n

    def split(self, node: int, feature: int, threshold: float, below: float, above: float) -> tuple[int, int]:
        self.feature[node], self.threshold[node] = int(feature), float(threshold)
        self.left[node], self.right[node] = self.leaf(below), self.leaf(above)
        return self.left[node], self.right[node]


class Ensemble:
    """The sum of ``weight`` times each tree, and ``base``.

    A value is told by how many thresholds of its input lie below it, so that nodes compare small whole numbers. Trees of few leaves
    ask all their nodes at once: a node that sends the row right rules out the leaves on its left, and the first leaf that stays is
    the row's. Others are walked down step by step, by all rows and trees at once.
    """

    def __init__(self, trees: list[Tree], weight: float, base: float = 0.0) -> None:
        self.shape, self.weight, self.base = (len(trees), max(len(t.value) for t in trees)), weight, base
        inner = [(f, x) for t in trees for n, (f, x) in enumerate(zip(t.feature, t.threshold)) if t.left[n] != n]
        self.inputs = sorted({f for f, _ in inner}) or [0]
        self.thresholds = [np.unique([x for g, x in inner if g == f]) for f in self.inputs]
        leaves = max(sum(n == left for n, left in enumerate(t.left)) for t in trees)
        self.few = leaves <= LEAVES
        if self.few:
            self._ask_all(trees, leaves)
        else:
            self._lay_out(trees)

    def _asked(self, t: Tree, n: int) -> int:
        """Input and threshold of a node in one number; a row goes right if its own number for this input is larger."""
        f = self.inputs.index(t.feature[n])
        return (f << SHIFT) + int(np.searchsorted(self.thresholds[f], t.threshold[n]))

    def _ask_all(self, trees: list[Tree], leaves: int) -> None:
        shape = max(1, leaves - 1), len(trees), 1
        self.ask, self.left_of = np.full(shape, (1 << SHIFT) - 1), np.zeros(shape, np.uint16)
        self.value = np.zeros((len(trees), LEAVES))

        def visit(i: int, t: Tree, n: int, slots: Iterator[int], first: int) -> int:
            """Numbers the leaves below a node from ``first`` on, and returns the number after the last."""
            if t.left[n] == n:
                self.value[i, first] = t.value[n]
                return first + 1
            slot = next(slots)
            middle = visit(i, t, t.left[n], slots, first)
            self.ask[slot, i], self.left_of[slot, i] = self._asked(t, n), (1 << middle) - (1 << first)
            return visit(i, t, t.right[n], slots, middle)

        for i, t in enumerate(trees):
            visit(i, t, 0, iter(range(leaves)), 0)

    def _lay_out(self, trees: list[Tree]) -> None:
        """Nodes of all trees in one row, the left child of each (the right one stands next to it), and how many steps the longest way has."""
        begin = np.cumsum([0, *[len(t.value) for t in trees]])
        self.ask = np.full(begin[-1], (1 << SHIFT) * len(self.inputs) - 1)
        self.left, self.value, self.roots = np.arange(begin[-1]), np.concatenate([t.value for t in trees]), begin[:-1]
        self.steps = 0
        for at, t in zip(begin.tolist(), trees):
            now = [0]
            for step in range(len(t.value)):
                now = [n for n in now if t.left[n] != n]
                if not now:
                    break
                self.steps = max(self.steps, step + 1)
                for n in now:
                    self.ask[at + n], self.left[at + n] = self._asked(t, n), at + t.left[n]
                now = [m for n in now for m in (t.left[n], t.right[n])]

    def _found(self, own: np.ndarray) -> np.ndarray:
        """The value of each tree (first axis) for each row (second axis of both)."""
        if self.few:
            out = np.zeros((len(self.value), own.shape[1]), np.uint16)
            for ask, left_of in zip(self.ask, self.left_of):
                out |= (own.take(ask[:, 0] >> SHIFT, axis=0) > ask) * left_of
            first = FIRST.take(~out & (out + np.uint16(1)))
            return self.value.ravel().take(first + (np.arange(len(out)) * LEAVES)[:, None])
        flat, row = own.T.ravel(), (np.arange(own.shape[1]) * own.shape[0])[None, :]
        node = np.broadcast_to(self.roots[:, None], (len(self.roots), own.shape[1]))
        for _ in range(self.steps):
            asked = self.ask.take(node)
            node = self.left.take(node) + (flat.take((asked >> SHIFT) + row) > asked)
        return self.value.take(node)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Of each row of ``x``; a missing value is above all thresholds."""
        out, step = np.empty(len(x)), max(1, PASS // self.shape[0])
        x = np.where(np.isnan(x), np.inf, x)[:, self.inputs]
        own = np.stack([(f << SHIFT) + np.searchsorted(t, c, "left") for f, (t, c) in enumerate(zip(self.thresholds, x.T))])
        for a in range(0, len(x), step):
            out[a : a + step] = self.base + self.weight * self._found(own[:, a : a + step]).sum(axis=0)
        return out


def edges_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Per input the thresholds between its bins: halfway between neighbouring values where they are few, else quantiles."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))
            out.append(values)
        else:
            out.append((values[1:] + values[:-1]) / 2)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers: a value lies in bin b where it is above edge b - 1 and not above edge b."""
    return np.column_stack([np.searchsorted(e, c, "left") for c, e in zip(x.T, edges)]).astype(np.int64)


def histograms(bins: np.ndarray, node: np.ndarray, nodes: int, width: int, *weights: np.ndarray) -> list[np.ndarray]:
    """Sums of each weight by (node, input, bin)."""
    inputs = bins.shape[1]
    key = ((node[:, None] * inputs + np.arange(inputs)) * width + bins).ravel()
    shape = (nodes, inputs, width)
    return [np.bincount(key, np.repeat(w, inputs), nodes * inputs * width).reshape(shape) for w in weights]


def best_cuts(
    count: np.ndarray, total: np.ndarray, least: float, l2: float, allowed: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, input, bin) of the best cut per node; rows up to the bin go left. Gain is minus infinity without a cut."""
    n, s = count.cumsum(axis=2), total.cumsum(axis=2)
    n_all, s_all = n[:, :, -1:], s[:, :, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s**2 / (n + l2) + (s_all - s) ** 2 / (n_all - n + l2) - s_all**2 / (n_all + l2)
    good = (n >= least) & (n_all - n >= least)
    if allowed is not None:
        good &= allowed[:, :, None]
    gain = np.where(good, gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    return flat[np.arange(len(flat)), at], at // gain.shape[2], at % gain.shape[2]


def fit_tree(
    bins: np.ndarray, edges: list[np.ndarray], y: np.ndarray, weight: np.ndarray, depth: int, least: int, inputs: int,
    rng: np.random.Generator,
) -> Tree:
    """One tree, level by level; each node looks at ``inputs`` inputs drawn anew and leaves at least ``least`` weight on a side."""
    rows = np.flatnonzero(weight)
    bins, y, weight = bins[rows], y[rows], weight[rows].astype(float)
    tree = Tree.root(float((weight * y).sum() / weight.sum()))
    node, names, width = np.zeros(len(rows), np.int64), [0], max(len(e) for e in edges) + 1
    for _ in range(depth):
        count, total = histograms(bins, node, len(names), width, weight, weight * y)
        draw = rng.random((len(names), bins.shape[1])).argsort(axis=1).argsort(axis=1) < inputs
        gain, feature, cut = best_cuts(count, total, least, 0.0, draw)
        place, new = np.full((len(names), 2), -1), []
        for k in np.flatnonzero(gain > 1e-12):
            f, b = feature[k], cut[k]
            n, s = count[k, f].cumsum(), total[k, f].cumsum()
            children = tree.split(names[k], f, edges[f][b], s[b] / n[b], (s[-1] - s[b]) / (n[-1] - n[b]))
            place[k] = len(new), len(new) + 1
            new += children
        if not new:
            break
        above = bins[np.arange(len(node)), feature[node]] > cut[node]
        node = place[node, above.astype(int)]
        live = node >= 0
        bins, y, weight, node, names = bins[live], y[live], weight[live], node[live], new
    return tree


def fit_forest(
    x: np.ndarray, y: np.ndarray, trees: int, depth: int, least: int = 3, share: float = 0.9, seed: int = 42,
) -> list[Tree]:
    """Trees on draws of the rows with replacement."""
    edges = edges_of(x)
    bins, inputs = binned(x, edges), max(1, int(share * x.shape[1]))
    out = []
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        weight = np.bincount(rng.integers(0, len(x), len(x)), minlength=len(x))
        out.append(fit_tree(bins, edges, y, weight, depth, least, inputs, rng))
    return out


def fit_boosting(
    x: np.ndarray, y: np.ndarray, rounds: int, step: float, leaves: int, l2: float, least: int = 20,
) -> tuple[list[Tree], float]:
    """(trees, base): each tree grows its best leaf first, to ``leaves`` leaves, on what the trees before leave of squared loss.

    ``l2`` adds to the weight of every leaf. The histogram of the larger of two children is what the smaller one leaves.
    """
    edges = edges_of(x)
    bins, width = binned(x, edges), max(len(e) for e in edges) + 1
    base, out = float(y.mean()), []
    left_over = y - base

    def measured(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(histograms(bins[rows], np.zeros(len(rows), np.int64), 1, width, np.ones(len(rows)), left_over[rows]))

    for _ in range(rounds):
        tree, every = Tree.root(0.0), np.arange(len(y))
        open_ = {0: (every, *measured(every))}
        cuts = {0: best_cuts(*open_[0][1:], least, l2)}
        while len(open_) < leaves:
            node = max(cuts, key=lambda k: (cuts[k][0][0], -k))
            gain, feature, cut = (v[0] for v in cuts.pop(node))
            if gain <= 1e-12:
                break
            rows, count, total = open_.pop(node)
            above = bins[rows, feature] > cut
            parts = rows[~above], rows[above]
            small = int(len(parts[1]) < len(parts[0]))
            one = measured(parts[small])
            other = count - one[0], total - one[1]
            sides = (one, other) if small == 0 else (other, one)
            names = tree.split(node, feature, edges[feature][cut], 0.0, 0.0)
            for name, part, held in zip(names, parts, sides):
                open_[name] = (part, *held)
                cuts[name] = best_cuts(*held, least, l2)
        for name, (rows, *_) in open_.items():
            tree.value[name] = step * float(left_over[rows].sum()) / (len(rows) + l2)
            left_over[rows] -= tree.value[name]
        out.append(tree)
    return out, base

"""Regression forests and boosting on a few hundred rows, inside one task.

A sector's training rows are months: too few for a job per tree level, and
there are many fits (sectors x grid points x folds). Each fit is therefore one
grouped task that grows its trees with numpy, and Spark spreads the fits (see
``plans.grouped_training``). Trees are grown greedily by the reduction of the
squared error; a row with a missing value goes right.

Trees are added one after another and the n-th draws its rows from a generator
of its own, so the first n trees of an ensemble are those of a smaller one:
grid points that differ in their number of trees alone are scored by one fit.
"""
from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

FOREST, BOOSTING = "random_forest", "gradient_boosting"


def best_split(x: np.ndarray, y: np.ndarray, w: np.ndarray, min_leaf: int) -> tuple[float, int, float] | None:
    """(gain, feature, threshold) of the best split of weighted rows, the first
    of equal ones; None if there is none."""
    order = np.argsort(x, axis=0, kind="stable")
    v = np.take_along_axis(x, order, axis=0)
    left_w, left_s = np.cumsum(w[order], axis=0)[:-1], np.cumsum((w * y)[order], axis=0)[:-1]
    all_w, all_s = w.sum(), (w * y).sum()
    right_w = all_w - left_w
    ok = (v[1:] > v[:-1]) & (left_w >= min_leaf) & (right_w >= min_leaf)
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, left_s ** 2 / left_w + (all_s - left_s) ** 2 / right_w - all_s ** 2 / all_w, -np.inf)
    f = int(np.argmax(gain.max(axis=0)))
    i = int(np.argmax(gain[:, f]))
    if not gain[i, f] > 1e-12:
        return None
    return float(gain[i, f]), f, float((v[i, f] + v[i + 1, f]) / 2)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, min_split: int, min_leaf: int) -> tuple[list, np.ndarray]:
    """Nodes (feature or -1, threshold, left, right, value) of a tree, the root
    first, and the gain of each feature. ``w``: how often a row is drawn."""
    nodes, gains = [], np.zeros(x.shape[1])
    todo = [(np.flatnonzero(w > 0), 0, None, 0)]
    while todo:
        rows, level, parent, side = todo.pop()
        if parent is not None:
            nodes[parent][side] = len(nodes)
        weight = w[rows].sum()
        nodes.append([-1, 0.0, -1, -1, float((w[rows] * y[rows]).sum() / weight) if weight else 0.0])
        if level >= depth or weight < min_split or len(rows) < 2:
            continue
        split = best_split(x[rows], y[rows], w[rows], min_leaf)
        if split is None:
            continue
        gain, f, threshold = split
        gains[f] += gain
        me = len(nodes) - 1
        nodes[me][:2] = [f, threshold]
        left = x[rows, f] <= threshold
        todo += [(rows[~left], level + 1, me, 3), (rows[left], level + 1, me, 2)]
    return nodes, gains


@dataclass
class Ensemble:
    """Trees one after another (nodes as columns), what they start from and
    what each counts; ``importances`` sum to 1, or are all 0."""
    start: float
    weight: float
    mean: bool
    first: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    importances: np.ndarray

    def stages(self, x: np.ndarray):
        """Predictions with the first tree, the first two, and so on."""
        total = np.full(len(x), self.start)
        for n, (a, b) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist()), 1):
            at = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[a + at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                goes_left = x[inner, f[inner]] <= self.threshold[a + at[inner]]
                at[inner] = np.where(goes_left, self.left[a + at[inner]], self.right[a + at[inner]])
            total = total + self.weight * self.value[a + at]
            yield total / n if self.mean else total

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for out in self.stages(x):
            pass
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{k: np.asarray(v) for k, v in vars(self).items()})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Ensemble":
        with np.load(io.BytesIO(raw), allow_pickle=False) as z:
            got = {k: z[k] for k in z.files}
        return cls(float(got["start"]), float(got["weight"]), bool(got["mean"]), *[got[k] for k in (
            "first", "feature", "threshold", "left", "right", "value", "importances")])


def _ensemble(start: float, weight: float, mean: bool, trees: list[list], gains: list[np.ndarray], features: int) -> Ensemble:
    nodes = np.array([n for t in trees for n in t], float).reshape(-1, 5)
    first = np.cumsum([0, *map(len, trees)])
    shares = [g / g.sum() for g in gains if g.sum() > 0]
    importances = np.mean(shares, axis=0) if shares else np.zeros(features)
    whole = [nodes[:, k].astype(np.int64) for k in (0, 2, 3)]
    return Ensemble(start, weight, mean, first, whole[0], nodes[:, 1], whole[1], whole[2], nodes[:, 4], importances)


def fit(name: str, point: dict, x: np.ndarray, y: np.ndarray, seed: int) -> Ensemble:
    """A forest (rows drawn with replacement, mean of the trees) or boosting
    (stages on what is left, a share of the rows each) of a grid point."""
    n, trees, gains = len(y), [], []
    split, leaf = point.get("min_samples_split", 2), point.get("min_samples_leaf", 1)
    if name == FOREST:
        for t in range(point["n_estimators"]):
            rng = np.random.default_rng([seed, t])
            w = np.bincount(rng.integers(0, n, n), minlength=n).astype(float)
            nodes, gain = grow(x, y, w, point["max_depth"], split, leaf)
            trees.append(nodes)
            gains.append(gain)
        return _ensemble(0.0, 1.0, True, trees, gains, x.shape[1])
    rate, drawn = point["learning_rate"], max(1, int(point["subsample"] * n))
    start = float(y.mean())
    now = np.full(n, start)
    for t in range(point["n_estimators"]):
        w = np.zeros(n)
        w[np.random.default_rng([seed, t]).permutation(n)[:drawn]] = 1.0
        nodes, gain = grow(x, y - now, w, point["max_depth"], split, leaf)
        trees.append(nodes)
        gains.append(gain)
        one = _ensemble(0.0, 1.0, False, [nodes], [gain], x.shape[1])
        now = now + rate * one.predict(x)
    return _ensemble(start, rate, False, trees, gains, x.shape[1])


def staged_errors(model: Ensemble, sizes: list[int], x: np.ndarray, y: np.ndarray) -> list[float]:
    """Mean absolute error on (x, y) of the first n trees, for every n."""
    wanted, found = set(sizes), {}
    for n, p in enumerate(model.stages(x), 1):
        if n in wanted:
            found[n] = float(np.abs(p - y).mean())
    return [found[n] for n in sizes]

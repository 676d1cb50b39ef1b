"""Gradient-boosted regression trees in numpy, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """An ensemble of trees of one depth, laid out as complete binary trees."""

    edges: list[np.ndarray]  # per feature, upper edges of its bins
    feature: np.ndarray  # (trees, inner nodes)
    at: np.ndarray  # (trees, inner nodes): to the right if the bin is greater
    value: np.ndarray  # (trees, leaves)
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, at, v in zip(self.feature, self.at, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (b[rows, f[node]] > at[node])
            out += v[node - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 150, depth: int = 4, rate: float = 0.08, least: int = 8, share: float = 0.6, seed: int = 5) -> Trees:
    """Least squares by gradient boosting; every tree sees a share of the features. x must be finite."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    model = Trees(edges, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), BINS, np.int64), np.zeros((trees, 2**depth)), float(y.mean()))
    b = model.bins(x).astype(np.int64)
    rng = np.random.default_rng(seed)
    fitted = np.full(n, model.base)
    for t in range(trees):
        rest = y - fitted
        cols = np.sort(rng.choice(m, max(1, round(share * m)), replace=False))
        node = np.zeros(n, np.int64)
        for d in range(depth):
            first, count = 2**d - 1, 2**d
            at = node - first
            gains = np.full((count, len(cols)), -1.0)
            cuts = np.zeros((count, len(cols)), np.int64)
            for i, j in enumerate(cols):
                key = at * BINS + b[:, j]
                size = np.bincount(key, minlength=count * BINS).reshape(count, BINS).cumsum(1)
                total = np.bincount(key, rest, minlength=count * BINS).reshape(count, BINS).cumsum(1)
                right_n, right = size[:, -1:] - size, total[:, -1:] - total
                ok = (size >= least) & (right_n >= least)
                gain = np.where(ok, total**2 / np.maximum(size, 1) + right**2 / np.maximum(right_n, 1), -1.0)
                cuts[:, i] = gain.argmax(1)
                gains[:, i] = gain.max(1) - total[:, -1] ** 2 / np.maximum(size[:, -1], 1)
            best = gains.argmax(1)
            for k in range(count):
                if gains[k, best[k]] > 1e-9:
                    model.feature[t, first + k], model.at[t, first + k] = cols[best[k]], cuts[k, best[k]]
            f = model.feature[t, node]
            node = 2 * node + 1 + (b[np.arange(n), f] > model.at[t, node])
        leaf = node - (2**depth - 1)
        size = np.bincount(leaf, minlength=2**depth)
        model.value[t] = rate * np.bincount(leaf, rest, minlength=2**depth) / (size + 1.0)
        fitted += model.value[t][leaf]
    return model


def cut_points(scores: np.ndarray, levels: np.ndarray, grades: int = 4) -> np.ndarray:
    """Thresholds between neighbouring grades that misplace the fewest of the scored rows."""
    cuts = []
    for g in range(1, grades):
        order = np.argsort(scores, kind="stable")
        s, above = scores[order], levels[order] > g
        wrong = np.concatenate([[0], np.cumsum(above)]) + (~above).sum() - np.concatenate([[0], np.cumsum(~above)])
        inside = (np.concatenate([[-np.inf], s]) >= g - 0.1) & (np.concatenate([[-np.inf], s]) <= g + 1.1)
        wrong = np.where(inside, wrong, len(s) + 1)
        if not inside.any():
            cuts.append(g + 0.5)
            continue
        best = np.flatnonzero(wrong == wrong.min())
        k = int(best[len(best) // 2])
        cuts.append(float((s[k - 1] + s[min(k, len(s) - 1)]) / 2))
    return np.maximum.accumulate(np.array(cuts))

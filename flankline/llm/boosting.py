"""Small models that are fitted on bounded samples: boosted trees, isotonic steps and logistic regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: feature and threshold of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, smooth: float = 1.0) -> Trees:
    """Gradient boosting with logistic loss and second-order gains over quantile bins."""
    n, width = x.shape
    weight = weight * (n / weight.sum())
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    share = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    features, thresholds, leaves = [], [], []
    score = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            gain, chosen = np.full(many, 1e-9), [(0, np.inf)] * many
            for f in range(width):
                key = (node - first) * (bins + 1) + binned[:, f]
                gs = np.bincount(key, g, many * (bins + 1)).reshape(many, -1).cumsum(axis=1)
                hs = np.bincount(key, h, many * (bins + 1)).reshape(many, -1).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                found = gs**2 / (hs + smooth) + (gt - gs) ** 2 / (ht - hs + smooth) - gt**2 / (ht + smooth)
                found[(hs < 1e-3) | (ht - hs < 1e-3)] = 0
                for k in range(many):
                    b = int(found[k, : len(edges[f])].argmax()) if len(edges[f]) else 0
                    if len(edges[f]) and found[k, b] > gain[k]:
                        gain[k], chosen[k] = found[k, b], (f, edges[f][b])
            for k, (f, t) in enumerate(chosen):
                feature[first + k], threshold[first + k] = f, t
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + smooth)
        score += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


@dataclass
class Steps:
    """Isotonic calibration: a rising function, linear between the means of its steps."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)


def fit_steps(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Steps:
    """Pool adjacent violators; each step is drawn towards the overall rate by one row's weight, so that no score is a
    certainty that the rows do not bear out."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # low, high, weight, weighted labels
    for r, label, w in zip(raw[order], y[order], weight[order], strict=True):
        if blocks and blocks[-1][1] == r:
            blocks[-1][2] += w
            blocks[-1][3] += w * label
        else:
            blocks.append([r, r, w, w * label])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            low, high, w2, s2 = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + w2, blocks[-1][3] + s2]
    rate, one = float((weight * y).sum() / weight.sum()), float(weight.mean())
    value = [(s + one * rate) / (w + one) for _, _, w, s in blocks]
    x = [e for low, high, _, _ in blocks for e in (low, high)]
    return Steps(np.array(x), np.maximum.accumulate(np.repeat(value, 2)))


@dataclass
class Logit:
    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return z @ self.weight[:-1] + self.weight[-1]


def fit_logit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logit:
    """Ridge logistic regression by damped Newton steps on standardised features."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.clip((x - mean) / spread, -8, 8), np.ones(len(x))])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (y - p)) - penalty * w
        hess = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Logit(mean, spread, w)

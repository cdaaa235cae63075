"""Small gradient-boosted trees for two classes: fitted in arrays, applied in arrays or as a Spark SQL expression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

DEPTH, TREES, RATE, BINS = 3, 40, 0.3, 32


@dataclass
class Trees:
    """Complete trees of DEPTH levels: node i goes to 2 i + 1 if its feature is at most the threshold, else to 2 i + 2."""

    names: list[str]
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log-odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (2**DEPTH - 1)]
        return self.shift + self.slope * out

    def sql(self, prefix: str = "") -> str:
        """The same as Spark SQL text over features by name, each after a prefix: parsed at once, however many trees."""

        def branch(tree: int, node: int) -> str:
            if node >= 2**DEPTH - 1:
                return f"{float(self.leaves[tree][node - (2**DEPTH - 1)])!r}D"
            if not np.isfinite(self.thresholds[tree][node]):
                return branch(tree, 2 * node + 1)
            low = f"{prefix}{self.names[self.features[tree][node]]} <= {float(self.thresholds[tree][node])!r}D"
            return f"IF({low}, {branch(tree, 2 * node + 1)}, {branch(tree, 2 * node + 2)})"

        total = " + ".join([f"{self.base!r}D", *(branch(t, 0) for t in range(len(self.leaves)))])
        return f"({self.shift!r}D + {self.slope!r}D * ({total}))"


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, rate: float = RATE) -> Trees:
    """Boosted by second-order steps on logistic loss; splits are sought between at most BINS values of a feature."""
    y = y.astype(float)
    mean = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    out = Trees(names, float(np.log(mean / (1 - mean))))
    if not len(y) or y.min() == y.max():
        return out
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    codes = np.stack([np.searchsorted(cut, c, side="left") for cut, c in zip(cuts, x.T, strict=True)], axis=1)
    score = np.full(len(y), out.base)
    inner = 2**DEPTH - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        code = np.full(inner, BINS + 1)
        node = np.zeros(len(y), np.int64)
        for i in range(inner):
            here = np.flatnonzero(node == i)
            best = 1e-6
            gs, hs = g[here].sum(), h[here].sum()
            for f, cut in enumerate(cuts):
                if not len(cut) or len(here) < 2:
                    continue
                gl = np.cumsum(np.bincount(codes[here, f], g[here], len(cut) + 1))[:-1]
                hl = np.cumsum(np.bincount(codes[here, f], h[here], len(cut) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[i], threshold[i], code[i] = gain[k], f, cut[k], k
            node[here] = 2 * i + 1 + (codes[here, feature[i]] > code[i])
        leaf = np.zeros(inner + 1)
        for j in range(inner + 1):
            here = node == inner + j
            leaf[j] = rate * g[here].sum() / (h[here].sum() + 1)
        score += leaf[node - inner]
        out.features.append(feature)
        out.thresholds.append(threshold)
        out.leaves.append(leaf)
    return out


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray) -> Trees:
    """Scales and shifts the log-odds to fit rows that weren't fitted on, by Newton steps with a prior at 1 and 0."""
    if len(y):
        z = np.c_[model.margins(x), np.ones(len(y))]
        theta, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
            theta = theta + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(2), z.T @ (y - p) - (theta - prior))
        model.slope, model.shift = float(max(theta[0], 1e-3)), float(theta[1])
    return model

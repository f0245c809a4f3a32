"""Gradient-boosted regression trees for a yes/no label, on columns of numbers."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees of one depth, each level of a tree laid out after the other; the
    children of place i are 2i + 1 and 2i + 2."""

    base: float
    rate: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def dump(self) -> str:
        parts = [f'"{k}": {getattr(self, k)!r}' for k in ("base", "rate")]
        for k in ("features", "cuts", "leaves"):
            rows = ",\n".join(json.dumps([float(v) for v in row]).replace(".0,", ",").replace(".0]", "]") for row in getattr(self, k))
            parts.append(f'"{k}": [\n{rows}\n]')
        return "{" + ",\n".join(parts) + "}\n"

    @staticmethod
    def load(text: str) -> Forest:
        d = json.loads(text)
        return Forest(d["base"], d["rate"], np.array(d["features"], np.int64), np.array(d["cuts"], np.float64), np.array(d["leaves"], np.float64))

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        inner = self.features.shape[1]
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(x) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += self.rate * leaf[at - inner]
        return total


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Forest:
    """Fits trees by second-order logistic loss, on quantile bins of the columns."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin, inner = np.full(n, base), 2**depth - 1
    all_features, all_cuts, all_leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = at - first
            gain, which, where = np.zeros(count), np.zeros(count, np.int64), np.full(count, -1)
            for j in range(width):
                key = local * bins + binned[:, j]
                left_g = np.bincount(key, g, count * bins).reshape(count, bins).cumsum(1)
                left_h = np.bincount(key, h, count * bins).reshape(count, bins).cumsum(1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                value = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                value = value[:, : len(edges[j])]
                if value.shape[1]:
                    best = value.argmax(1)
                    better = value[np.arange(count), best] > gain + 1e-9
                    gain = np.where(better, value[np.arange(count), best], gain)
                    which, where = np.where(better, j, which), np.where(better, best, where)
            for k in range(count):
                if where[k] >= 0:
                    feature[first + k], cut[first + k] = which[k], edges[which[k]][where[k]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf = -np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + ridge)
        margin += rate * leaf[at - inner]
        all_features.append(feature)
        all_cuts.append(cut)
        all_leaves.append(leaf)
    return Forest(base, rate, np.array(all_features), np.array(all_cuts), np.array(all_leaves))

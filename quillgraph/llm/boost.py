"""Gradient-boosted oblivious trees: fitted on a bounded sample, scored as a Spark column.

All nodes of one level of a tree ask the same question, so a tree is a few comparisons and one lookup in a constant
array, and a whole model stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Boosted:
    features: Sequence[str]
    base: float
    trees: list[tuple[list[tuple[int, float]], list[float]]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for questions, leaves in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for f, edge in questions:
                at = 2 * at + (x[:, f] > edge)
            out += np.asarray(leaves)[at]
        return out

    def column(self, by_name: Mapping[str, Column]) -> Column:
        """The log-odds, from one double column for each feature."""
        out = F.lit(float(self.base))
        for questions, leaves in self.trees:
            at = F.lit(0)
            for f, edge in questions:
                at = at * 2 + F.when(by_name[self.features[f]] > F.lit(float(edge)), 1).otherwise(0)
            out = out + F.get(F.array(*[F.lit(float(v)) for v in leaves]), at)
        return out


def fit(features: Sequence[str], x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0) -> Boosted:
    """Log-loss boosting by histograms. With no rows or one class the model is a constant."""
    n, positives = len(y), float(np.sum(y))
    share = (positives + 0.5) / (n + 1.0)
    model = Boosted(features, float(np.log(share / (1 - share))))
    if positives in (0.0, float(n)):
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]
    score = np.full(n, model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node, questions = np.zeros(n, dtype=np.int64), []
        for level in range(depth):
            best = (-1.0, 0, 0)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                width, nodes = len(e) + 1, 2**level
                sums = [np.bincount(node * width + binned[f], weights=v, minlength=nodes * width).reshape(nodes, width).cumsum(axis=1) for v in (g, h)]
                (gl, hl), (ga, ha) = [s[:, :-1] for s in sums], [s[:, -1:] for s in sums]
                gain = (gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2)).sum(axis=0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            _, f, k = best
            questions.append((f, float(edges[f][k]) if len(edges[f]) else 0.0))
            node = 2 * node + (binned[f] > k)
        grad, hess = (np.bincount(node, weights=v, minlength=2**depth) for v in (g, h))
        leaves = -rate * grad / (hess + l2)
        model.trees.append((questions, leaves.tolist()))
        score += leaves[node]
    return model


def threshold_for(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest margin at and above which at least that share of the rows is positive; infinite if there is none."""
    if not len(y):
        return float("inf")
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    ends = np.append(s[1:] != s[:-1], True)
    good = ends & (hits >= precision * np.arange(1, len(y) + 1))
    return float(s[np.flatnonzero(good)[-1]]) if good.any() else float("inf")

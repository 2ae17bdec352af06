"""Binary maximum-entropy model over sets of named features, fitted on the driver from a bounded sample."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np


def fit(rows: list[list[str]], labels: list[float], epochs: int = 4, rate: float = 0.3, l2: float = 1e-5, least: int = 2, seed: int = 7) -> dict[str, float]:
    """Weights by feature name (and '' the bias); labels may be probabilities. AdaGrad over shuffled blocks of rows.

    Features of fewer than `least` rows are left out. No rows give a model of bias 0.
    """
    counts = Counter(f for r in rows for f in set(r))
    names = {f: i + 1 for i, f in enumerate(sorted(f for f, c in counts.items() if c >= least))}
    weight, grads = np.zeros(len(names) + 1), np.full(len(names) + 1, 1e-6)
    ids = [np.array([0, *sorted({names[f] for f in r if f in names})]) for r in rows]
    y, rng = np.array(labels, float), np.random.default_rng(seed)
    for _ in range(epochs if rows else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            sizes = np.array([len(ids[i]) for i in part])
            flat = np.concatenate([ids[i] for i in part])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(weight[flat], starts), -30, 30)))
            used, place = np.unique(flat, return_inverse=True)
            g = np.bincount(place, np.repeat(p - y[part], sizes)) + l2 * weight[used]
            grads[used] += g * g
            weight[used] -= rate * g / np.sqrt(grads[used])
    return {"": float(weight[0])} | {f: float(weight[i]) for f, i in names.items() if abs(weight[i]) > 0.01}


def score(model: dict[str, float], features: list[str]) -> float:
    """Log odds; repeated features count once."""
    return model.get("", 0.0) + sum(model.get(f, 0.0) for f in dict.fromkeys(features))


def probability(model: dict[str, float], features: list[str]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, score(model, features)))))

"""Held-out splits and small fits that the learned operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression, by Newton's method with halved steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return np.logaddexp(0, -np.where(y > 0, z, -z)).sum() + 0.5 * ridge * len(x) * (w[:-1] ** 2).sum()

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        r = ridge * len(x) * np.append(np.ones(len(w) - 1), 1e-6)
        move = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(r + 1e-9), x.T @ (p - y) + r * w)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * move) > now:
            size /= 2
        w = w - size * move
        if size * np.abs(move).max() < 1e-8:
            break
    return w

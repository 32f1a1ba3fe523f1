"""Logistic models from positive and unlabelled examples: the non-negative unbiased risk.

With class prior p the risk of a model is ``p * R(positives as 1) + R(negatives as 0)``, where the
second part is estimated as ``R(unlabelled as 0) - p * R(positives as 0)``. A flexible model drives
that difference below zero, which no true risk can be; whenever it falls under ``-beta`` the step
goes against it instead (the non-negative correction). Plain numpy, for a bounded training sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Sparse:
    """Rows of 0/1 features: ``columns`` of row i lie at ``starts[i]:starts[i + 1]``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    def __post_init__(self):
        object.__setattr__(self, "rows", np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.columns], minlength=len(self.starts) - 1)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=g[self.rows], minlength=self.width)

    @staticmethod
    def of(lists: list[np.ndarray], width: int) -> Sparse:
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
        columns = np.concatenate(lists) if lists else np.empty(0, np.int64)
        return Sparse(starts, columns.astype(np.int64), width)


@dataclass(frozen=True)
class Dense:
    values: np.ndarray

    @property
    def width(self) -> int:
        return self.values.shape[1]

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.values @ w

    def back(self, g: np.ndarray) -> np.ndarray:
        return g @ self.values


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def fit(
    positive: Sparse | Dense,
    unlabelled: Sparse | Dense,
    prior: float,
    ridge: float = 1e-4,
    steps: int = 300,
    rate: float = 0.05,
    beta: float = 0.0,
) -> tuple[np.ndarray, float]:
    """Weights and intercept minimising the non-negative risk with Adam steps over all examples.

    Without positives or without unlabelled examples the model is the prior alone.
    """
    width = positive.width
    prior = float(min(max(prior, 1e-3), 1 - 1e-3))
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    n_pos, n_unl = len(positive.times(w)), len(unlabelled.times(w))
    if not n_pos or not n_unl:
        return w, b
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        zp, zu = positive.times(w) + b, unlabelled.times(w) + b
        sp, su = sigmoid(zp), sigmoid(zu)
        negative_risk = np.logaddexp(0.0, zu).mean() - prior * np.logaddexp(0.0, zp).mean()
        up = prior * (sp - 1.0) / n_pos  # slope of the positives' risk as 1
        down_p, down_u = -prior * sp / n_pos, su / n_unl  # slopes of the negatives' risk
        if negative_risk < -beta:
            gp, gu = -down_p, -down_u
        else:
            gp, gu = up + down_p, down_u
        grad = positive.back(gp) + unlabelled.back(gu) + ridge * w
        grad_b = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.999 * vb + 0.001 * grad_b * grad_b
        step = rate / (1.0 + 3.0 * t / steps)
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= step * fix * m / (np.sqrt(v) + 1e-8)
        b -= step * fix * mb / (np.sqrt(vb) + 1e-8)
    return w, b

"""Quality of a text by positive-unlabelled learning over the shape of the writing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from cuewright.llm.pu_learning import Dense, fit, sigmoid
from cuewright.llm.scoring import scored, training_sample
from cuewright.llm.text_features import N_SHAPE, shape


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        x = np.clip((shape(text) - self.mean) / self.scale, -8.0, 8.0)
        return float(sigmoid(x @ self.weights + self.intercept))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, most: int = 12_000) -> Model:
    """Fit on at most ``most`` trusted positives and ``most`` unlabelled texts outside the held-out fold.

    Features are centred and scaled by the unlabelled sample. Tables without any usable row give a
    model that answers with the prior (0.5 without labels).
    """
    positive, unlabelled, prior = training_sample(docs, labels, label, folds, held, most, shape)
    p = np.array(positive).reshape(-1, N_SHAPE)
    u = np.array(unlabelled).reshape(-1, N_SHAPE)
    mean = u.mean(axis=0) if len(u) else np.zeros(N_SHAPE)
    scale = np.maximum(u.std(axis=0), 0.01) if len(u) else np.ones(N_SHAPE)
    normal = [Dense(np.clip((x - mean) / scale, -8.0, 8.0)) for x in (p, u)]
    weights, intercept = fit(*normal, prior, ridge=1e-3, steps=400)
    return Model(mean, scale, weights, intercept)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, cut: float = 0.3) -> DataFrame:
    """Train, then score every row: ``doc_id, held_out, score, predicted``."""
    return scored(docs, folds, held, train(docs, labels, label, folds, held).score, cut)

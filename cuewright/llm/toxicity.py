"""Toxicity of a text by non-negative positive-unlabelled learning over the words it uses."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from cuewright.llm.pu_learning import Sparse, fit, sigmoid
from cuewright.llm.scoring import scored, training_sample
from cuewright.llm.text_features import word_set

WIDTH = 1 << 17
ENRICHED = 3.5


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        return float(sigmoid(self.weights[word_set(text, len(self.weights))].sum() + self.intercept))


def enriched(positive: Sparse, unlabelled: Sparse, least: float = ENRICHED) -> np.ndarray:
    """Features that trusted positives show more often than unlabelled texts, by ``least`` standard errors.

    Only these enter the fit; a feature seen in fewer than three positives never does.
    """
    n_p, n_u = len(positive.starts) - 1, len(unlabelled.starts) - 1
    in_p = np.bincount(positive.columns, minlength=positive.width)
    in_u = np.bincount(unlabelled.columns, minlength=unlabelled.width)
    share_p, share_u = (in_p + 0.5) / (n_p + 1), (in_u + 0.5) / (n_u + 1)
    error = np.sqrt(share_u * np.maximum(1 - share_u, 1e-9) * (1 / max(n_p, 1) + 1 / max(n_u, 1)))
    return np.flatnonzero((share_p - share_u > least * error) & (in_p >= 3))


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, most: int = 12_000, width: int = WIDTH
) -> Model:
    """Fit on at most ``most`` confirmed examples and ``most`` unlabelled texts outside the held-out fold.

    A feature is the presence of a hashed word or word beginning; ``width`` is the number of hash
    buckets. Tables without any usable row give a model that answers with the prior (0.5 without
    labels).
    """
    positive, unlabelled, prior = training_sample(docs, labels, label, folds, held, most, partial(word_set, width=width))
    chosen = enriched(Sparse.of(positive, width), Sparse.of(unlabelled, width))
    place = np.full(width, -1)
    place[chosen] = np.arange(len(chosen))
    small = [Sparse.of([place[x][place[x] >= 0] for x in rows], len(chosen)) for rows in (positive, unlabelled)]
    fitted, intercept = fit(*small, prior)
    weights = np.zeros(width)
    weights[chosen] = fitted
    return Model(weights, intercept)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, cut: float = 0.3) -> DataFrame:
    """Train, then score every row: ``doc_id, held_out, score, predicted``."""
    return scored(docs, folds, held, train(docs, labels, label, folds, held).score, cut)

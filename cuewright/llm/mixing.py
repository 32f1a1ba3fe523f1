"""Mixing documents to target domain weights with soft memberships.

A softmax classifier is fitted on a labelled table and gives each document a posterior over domains.
Documents get rates (expected copies) so that the expected tokens per domain meet the targets:
``minimise |A r - t|^2 over r >= 0`` with ``A[k, i] = tokens of i * posterior of k``. Projected
gradient steps run over all documents at once; the only state between steps is the residual per
domain. A document's rate after any number of steps follows from its own row and the residuals so
far, so no rate table is rewritten, and what travels is one number per domain and step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import stored
from cuewright.llm.text_features import N_SHAPE, shape
from cuewright.session import ship_package


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: np.ndarray

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8.0, 8.0) @ self.weights + self.intercept
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def train(docs: DataFrame, labelled: DataFrame, domains: Sequence[str], most: int = 8_000, steps: int = 200) -> Classifier:
    """Softmax regression on at most ``most`` rows of ``labelled (doc_id, domain)``, those with the smallest id hashes.

    Rows with another domain or without id or text row are not used; without any row all domains are
    equally likely.
    """
    ship_package(docs.sparkSession)
    known = labelled.filter(F.col("domain").isin(list(domains)) & F.col("doc_id").isNotNull())
    chosen = known.select(F.col("doc_id").cast("long").alias("doc_id"), "domain").dropDuplicates(["doc_id"])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("domain", "text")  # at most ``most`` ids

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([shape(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["domain", "x"])

    got = rows.mapInArrow(features, "domain string, x binary").toArrow()
    pairs = sorted(zip(got.column("domain").to_pylist(), got.column("x").to_pylist()))
    n, k = len(pairs), len(domains)
    if not n:
        return Classifier(tuple(domains), np.zeros(N_SHAPE), np.ones(N_SHAPE), np.zeros((N_SHAPE, k)), np.zeros(k))
    x = np.array([np.frombuffer(v) for _, v in pairs])
    y = np.eye(k)[[list(domains).index(d) for d, _ in pairs]]
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.01)
    x = np.clip((x - mean) / scale, -8.0, 8.0)
    w, b = np.zeros((N_SHAPE, k)), np.log(y.mean(axis=0) + 1e-3)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros(k), np.zeros(k)
    for t in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g, gb = x.T @ (p - y) / n + 1e-3 * w, (p - y).mean(axis=0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = 0.05 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= fix * m / (np.sqrt(v) + 1e-8)
        b -= fix * mb / (np.sqrt(vb) + 1e-8)
    return Classifier(tuple(domains), mean, scale, w, b)


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """``doc_id, tokens, p``: words of each text, and its posterior over the domains."""
    ship_package(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            if texts:
                p = model.posterior(np.array([shape(t) for t in texts]))
                arrays = [batch.column(0), pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "tokens", "p"])

    return rows.mapInArrow(run, "doc_id long, tokens long, p array<double>")


def _rates(tokens: np.ndarray, p: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Rates after the given steps: each is ``r = max(0, r - tokens * posterior . move)`` from r = 1."""
    r = np.ones(len(tokens))
    for move in moves:
        r = np.maximum(0.0, r - tokens * (p @ move))
    return r


def fit_rates(members: DataFrame, targets: Sequence[float], steps: int = 60, close: float = 1e-4) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, tokens, p, rate`` and the expected tokens per domain at the end.

    ``targets`` are shares of the corpus's tokens. Steps use the inverse of the largest eigenvalue of
    ``A A'`` and stop when every domain is within ``close`` of all tokens, or after ``steps``. Targets
    of a domain without members cannot be met and leave the others as near as they can be. Tables
    without tokens keep rate 1.
    """
    k = len(targets)
    wanted = np.array(targets, float) / max(sum(targets), 1e-12)
    weight = [F.col("tokens") * F.col("p")[i] for i in range(k)]
    square = [F.sum(weight[i] * weight[j]) for i in range(k) for j in range(k)]
    first = members.agg(F.sum("tokens"), *square).first()
    total = float(first[0] or 0)
    gram = np.array([float(x or 0) for x in first[1:]]).reshape(k, k)
    moves = np.zeros((0, k))

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k)
        for batch in batches:
            tokens, p = batch.column(0).to_numpy(zero_copy_only=False).astype(float), batch.column(1).flatten().to_numpy().reshape(-1, k)
            sums += (tokens * _rates(tokens, p, moves)) @ p
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["s"])

    def reached() -> np.ndarray:
        sums = members.select("tokens", "p").mapInArrow(partial_sums, "s array<double>")
        row = sums.agg(*[F.sum(F.col("s")[i]) for i in range(k)]).first()
        return np.array([float(x or 0) for x in row])

    got = reached() if total else np.zeros(k)
    if total:
        step = 1.0 / np.linalg.eigvalsh(gram).max()
        shift = np.linalg.pinv(gram / np.trace(gram), rcond=1e-6) / np.trace(gram)
        for n in range(steps):
            if np.abs(got - wanted * total).max() <= close * total:
                break
            # Scaled projected gradient: the metric A A' equalises the domains, the plain step is its fallback.
            scaled = shift @ (got - wanted * total)
            plain = step * (got - wanted * total)
            before, error = moves, np.abs(got - wanted * total).sum()
            moves = np.vstack([before, scaled])
            tried = reached()
            if np.abs(tried - wanted * total).sum() >= error:
                moves = np.vstack([before, plain])
                tried = reached()
            got = tried

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, p = batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(2).flatten().to_numpy().reshape(-1, k)
            made = np.round(_rates(tokens, p, moves), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=["doc_id", "tokens", "p", "rate"])

    return members.mapInArrow(rates, "doc_id long, tokens long, p array<double>, rate double"), got


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """``doc_id, tokens, p, rate`` of every row of ``docs``: posterior per domain and fitted rate.

    Null and empty texts have no tokens and rate 1. Repeated rows get equal rates; a null id stays
    null; an empty table gives no rows.
    """
    domains = list(targets)
    model = train(docs, labelled, domains)
    members = stored(posteriors(docs, model), "memberships")
    return fit_rates(members, [targets[d] for d in domains])[0]

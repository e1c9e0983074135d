"""Logistic regression on a bounded sample of labelled rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the constant

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 15) -> Logistic:
    """Penalised logistic regression by Newton steps; one class only gives its share everywhere."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + penalty * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-4:
            break
    return Logistic(mean, scale, w)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, doc_id: str, text: str, columns: tuple[str, ...], most: int
) -> DataFrame:
    """At most ``most`` rows of id, text and label columns of ``docs`` that have labels.

    Chosen by a hash of the id, so the choice does not depend on how rows are stored.
    The chosen ids are few enough to broadcast. Rows with a null id or label are left out;
    of an id labelled repeatedly each distinct label counts, and of documents that share
    an id the one with the greatest text, so repeated rows do not add to the bound.
    """
    chosen = (
        labels.select(F.col(doc_id).alias("__label_id"), *columns)
        .where(" and ".join(f"`{c}` is not null" for c in ("__label_id", *columns)))
        .distinct()
        .orderBy(F.xxhash64("__label_id"), "__label_id", *columns)
        .limit(most)
    )
    rows = docs.select(doc_id, text).join(F.broadcast(chosen), F.col(doc_id) == F.col("__label_id"))
    return rows.groupBy(doc_id, *columns).agg(F.max(text).alias(text))

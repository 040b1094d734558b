"""Small learners fitted on bounded samples of labelled rows, and the sample itself."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, lowest_hashes


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, most_chars: int) -> list[tuple[str, int]]:
    """Texts and labels of at most ``per_class`` rows of either label, outside the held-out fold.

    Only doc_ids and labels are sorted (by a hash of the doc_id, so the choice does not
    depend on order); texts are fetched for the chosen rows, by a join with at most
    2 * ``per_class`` ids. Texts over ``most_chars`` are left out of the sample, which
    bounds what reaches the driver; scoring takes every text whole. A doc_id with several
    texts gives the smallest of them.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where((crc_mod(F.col("doc_id"), folds) != held_out) & F.col("y").isin(0, 1)).distinct()
    hashed = F.xxhash64(F.col("doc_id"), F.lit(label))
    held = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    ids = [(r["doc_id"], r["y"]) for y in (0, 1) for r in lowest_hashes(usable.where(F.col("y") == y), hashed, held.get(y, 0), per_class).orderBy(hashed, F.col("doc_id")).limit(per_class).collect()]
    if not ids:
        return []
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, y int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= most_chars))
    # one text (the smallest) for each chosen doc_id and label, chosen before anything reaches the driver
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    return [(text, y) for _, text, y in sorted((r["doc_id"], r["text"], r["y"]) for r in rows)]


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60, balanced: bool = False) -> np.ndarray:
    """Weights (the last for the constant) of a ridge logistic fit, by Newton's method."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum()))) if balanced else np.ones(len(y))
    for _ in range(steps):
        p = sigmoid(x1 @ w)
        g = x1.T @ (weight * (p - y)) + ridge * w
        h = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(len(w)) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, passes: int = 30, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by Newton's method; a column of ones in ``x`` gives the constant."""
    sign = np.where(y == 1, 1.0, -1.0).astype(np.float32)
    c = (cost * (np.ones(len(y)) if weight is None else weight)).astype(np.float32)
    w = np.zeros(x.shape[1])
    for _ in range(passes):
        inside = np.flatnonzero(sign * (x @ w.astype(np.float32)) < 1)
        h, g = np.eye(len(w)), np.zeros(len(w))
        for at in range(0, len(inside), 2000):  # in blocks, as the rows are copied
            rows = inside[at : at + 2000]
            a = x[rows]
            g += 2.0 * (a.T @ (c[rows] * sign[rows]))
            h += 2.0 * (a.T @ (a * c[rows][:, None]))
        new = np.linalg.solve(h, g)
        if np.abs(new - w).max() < 1e-4 * max(1.0, np.abs(w).max()):
            return new
        w = new
    return w

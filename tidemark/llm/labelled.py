"""Bounded samples of labelled training rows, and a small logistic regression."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod


def training_sample(docs: DataFrame, labels: DataFrame, label: str, each: int) -> DataFrame:
    """doc_id, text, label of at most `each` rows of each class, the first by a hash of their ids among rows whose
    crc32(doc_id as text) mod 3 is not 1. `each` bounds what is broadcast and fitted; scores cover all rows. Of several labels
    of a doc_id the greatest counts, of several texts that of the least hash, so that reruns fit the same."""
    rows = labels.filter(crc_mod("doc_id", 3) != 1).groupBy("doc_id").agg(F.max(label).alias("label"))
    picked = None
    for y in (0, 1):
        some = rows.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        picked = some if picked is None else picked.unionByName(some)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "t.text", "label")


def held_out() -> "F.Column":
    return F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of the columns of x by Newton's method."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max(initial=0) < 1e-6:
            break
    return w

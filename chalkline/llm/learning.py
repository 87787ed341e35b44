"""Small linear models, fitted on the driver on a bounded sample of labelled rows."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of up to per_class rows of each class, the first by a hash of doc_id.

    The bound is on rows, so what is broadcast and collected here doesn't grow
    with the input. Rows without doc_id, label or document are left out.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").dropDuplicates(["doc_id"])
    order = [F.xxhash64(F.col("doc_id").cast("long")), F.col("doc_id")]
    picked = known.where("y = 0").orderBy(*order).limit(per_class).union(known.where("y = 1").orderBy(*order).limit(per_class))
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y").toArrow()
    got = {}
    for d, t, y in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), rows["y"].to_pylist()):
        got[d] = max(got.get(d, ("", y)), (t, y))
    return [(d, *got[d]) for d in sorted(got)]


def released() -> None:
    """What the driver's Python has freed goes back to the system, so that later steps don't carry the memory of a fit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_sparse(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, dims: int, steps: int = 120, l2: float = 1e-6, rate: float = 0.5) -> np.ndarray:
    """Logistic regression on rows given as (row, col, val), by full-batch Adagrad; classes weigh the same. The last weight is the bias."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, seen = np.zeros(dims + 1), np.full(dims + 1, 1e-12)
    for _ in range(steps):
        z = np.bincount(row, w[col] * val, len(y)) + w[-1]
        r = (sigmoid(z) - y) * weight
        g = np.append(np.bincount(col, r[row] * val, dims), r.sum())
        g[:-1] += l2 * w[:-1]
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def platt(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """a, b so that sigmoid(a * z + b) is the calibrated probability of y = 1 (Platt's targets, Newton's method)."""
    if len(z) == 0 or y.min() == y.max():
        return 1.0, 0.0
    scale = max(1e-9, float(np.abs(z).max()))
    x, n1, n0 = z / scale, (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * x + b)
        h = np.maximum(p * (1 - p), 1e-9)
        ga, gb = ((p - t) * x).sum() + 1e-6 * a, (p - t).sum()
        haa, hab, hbb = (h * x * x).sum() + 1e-6, (h * x).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 10 / max(1e-9, abs(da) + abs(db)))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a / scale), float(b)

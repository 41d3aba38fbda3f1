"""Kernel ridge regression by landmarks.

The kernel between all pairs of rows is never formed. A bounded keyed sample of rows serves as
landmarks; a row becomes its kernel values to them, whitened by the landmarks' own kernel, and
the Gram matrix of these features is the only thing that leaves the tasks. With all rows as
landmarks the result is full kernel ridge.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import u01
from .linear import gram, matrices
from .vectors import doubles

#: Numbers that landmarks may hold; they travel with the tasks' code.
LIMIT = 4_000_000


def rbf(x: np.ndarray, landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |x - l|^2) for every row and landmark."""
    d = (x * x).sum(1)[:, None] + (landmarks * landmarks).sum(1)[None, :] - 2.0 * x @ landmarks.T
    return np.exp(-gamma * np.maximum(d, 0.0))


def _apply(fn, kind: str):
    @F.pandas_udf(kind)
    def udf(v: pd.Series) -> pd.Series:
        out: list = [None] * len(v)
        at = np.flatnonzero(v.notna().to_numpy())
        if len(at):
            for i, r in zip(at, fn(np.vstack(v.iloc[at].to_numpy()).astype(float))):
                out[i] = r
        return pd.Series(out, dtype=object)

    return udf


@dataclass
class KernelRidge:
    """Weights on landmarks; all of model size."""

    landmarks: np.ndarray
    weights: np.ndarray
    mean: float
    gamma: float

    def predict(self, vec) -> Column:
        """Prediction of a vector column, NULL for a NULL vector."""
        marks, w, m, g = self.landmarks, self.weights, self.mean, self.gamma
        return _apply(lambda x: rbf(x, marks, g) @ w + m, "double")(doubles(vec))


def scale_gamma(df: DataFrame, vec: str) -> float:
    """1 / (dimensions * variance of all entries), from one aggregate; 1 without variance."""
    s = df.filter(F.col(vec).isNotNull()).select(F.explode(doubles(vec)).alias("v"), F.size(vec).alias("k")).agg(
        F.var_pop("v").alias("v"), F.max("k").alias("k")).first()
    return 1.0 / (s["k"] * s["v"]) if s["v"] else 1.0


def fit(train: DataFrame, key: str, vec: str, y: str, landmarks: int = 256, alpha: float = 1.0, gamma: float | None = None,
        seed="landmark") -> KernelRidge:
    """Kernel ridge on all rows with a vector and a target, y centred.

    ``landmarks`` bounds the sample that the features refer to (ties of the draw go by the key);
    the fit itself takes every row. Raises on a table without such rows, and on more landmarks
    than fit the tasks.
    """
    d = train.select(F.col(key).alias("_k"), doubles(vec).alias("_x"), F.col(y).cast("double").alias("_y")).filter("_x is not null and _y is not null")
    gamma = scale_gamma(d, "_x") if gamma is None else gamma
    marks = np.array([r["_x"] for r in d.orderBy(u01(seed, "_k"), "_k", "_x").limit(landmarks).select("_x").collect()], float)
    if not marks.size:
        raise ValueError("no row has both a vector and a target")
    if marks.size > LIMIT:
        raise ValueError(f"landmarks hold more than {LIMIT} numbers")
    value, vector = np.linalg.eigh(rbf(marks, marks, gamma))
    used = value > value[-1] * 1e-12
    white = vector[:, used] / np.sqrt(value[used])
    m = int(used.sum())
    features = d.select(_apply(lambda x: rbf(x, marks, gamma) @ white, "array<double>")("_x").alias("_f"), "_y")
    g = matrices(gram(features, [], "_f", m, ["_y"]), [])[(0,)]
    mean = g[0, -1] / g[0, 0]
    w = np.linalg.solve(g[1:-1, 1:-1] + alpha * np.eye(m), g[1:-1, -1] - mean * g[1:-1, 0])
    return KernelRidge(marks, white @ w, float(mean), gamma)

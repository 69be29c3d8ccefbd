"""Vector functions as column expressions, and their numpy forms for grouped kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a, length: Column | None = None) -> Column:
    """Unit vector; a zero vector stays zero."""
    n = norm(a) if length is None else length
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: F.lit(0.0)))


def cosine(a, b) -> Column:
    """Cosine similarity, 0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def all_finite(a) -> Column:
    """Whether no element is NaN, infinite or null; null for a null array."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def logsumexp(a) -> Column:
    """Shifted by the maximum; an infinite maximum is the result."""
    top = F.array_max(a)
    return F.when(F.abs(top) == float("inf"), top).otherwise(top + F.log(F.aggregate(F.transform(a, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)))


def round_ties_even(x: Column) -> Column:
    """Nearest whole number; within 1e-6 of a half the even neighbour."""
    low = F.floor(x)
    part = x - low
    return F.when(part < 0.5 - 1e-6, low).when(part > 0.5 + 1e-6, F.ceil(x)).otherwise(F.when(F.pmod(low, F.lit(2)) == 0, low).otherwise(low + 1)).cast("int")


def half_to_single(raw: bytes) -> np.ndarray:
    """Little-endian half floats as single floats."""
    return np.frombuffer(raw, "<f2").astype("float32")


def np_normalize_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length in their own precision; zero rows unchanged."""
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=m.copy(), where=length > 0)


def np_logsumexp(m: np.ndarray) -> np.ndarray:
    top = m.max(axis=-1, keepdims=True)
    with np.errstate(invalid="ignore"):
        out = top + np.log(np.exp(m - top).sum(axis=-1, keepdims=True))
    return np.where(np.isinf(top), top, out)[..., 0]

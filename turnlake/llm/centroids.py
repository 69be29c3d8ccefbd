"""Centroid clustering of integer vectors, exact at any magnitude.

Squared distances of a block of vectors to all centroids are one matrix product:
|x|^2 - 2 x.c + |c|^2 in float64 BLAS.  All numbers are integers, so the product is
exact as long as no partial sum reaches 2^53, which a bound on the magnitudes of the
block's rows and of the centroids proves; rows beyond the bound are computed in 64-bit
integers, and rows beyond those in Python's integers.

A round is one pass over the table: tasks add up vectors and counts by cluster, and
``RDD.treeAggregate`` adds the tasks' sums together, so the driver gets sums of
``k * dims`` numbers, however many rows there are.  Nothing is shuffled but these, and
the centroids (``k * dims`` numbers too) go to the tasks with their code.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows whose distances are computed at once.
BLOCK = 8192
#: Fan-in depth of the tree of sums.
DEPTH = 2
EXACT_DOUBLE, EXACT_LONG = 1 << 53, 1 << 63
_LONGEST = (1 << 63) - 1


def usable(vectors: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors with ``dims`` components, none null or non-finite, and these as a matrix of doubles."""
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    at = np.flatnonzero(lengths == dims)
    flat = vectors.take(pa.array(at)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(len(at), dims)  # nulls become NaN
    fine = np.isfinite(x).all(axis=1)
    return at[fine], x[fine]


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles where all are below 2^53 (exact), else Python's integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    if y.size == 0 or np.abs(y).max() < EXACT_DOUBLE:
        return y
    out = np.empty(x.shape, object)
    for i in np.ndindex(*x.shape):
        top, bottom = float(x[i]).as_integer_ratio()
        out[i] = scale * top // bottom
    return out


def _magnitude(x: np.ndarray) -> np.ndarray:
    return np.abs(x).max(axis=1, initial=0) if x.shape[1] else np.zeros(len(x))


def distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances (rows, centroids) of rows of integers; doubles, 64-bit or Python's integers, as the bound asks."""
    dims, most = x.shape[1], max((abs(v) for c in centroids for v in c), default=0)
    peak = int(_magnitude(x).max(initial=0))
    bound = dims * (peak + most) ** 2  # of |x|^2 + 2|x.c| + |c|^2 and of each partial sum
    if bound < EXACT_DOUBLE:
        x, c = x.astype("float64"), np.array(centroids, "float64").reshape(len(centroids), dims)
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    kind = "int64" if bound < EXACT_LONG else object
    x = np.array([[int(v) for v in row] for row in x], kind).reshape(x.shape)
    return np.stack([((x - np.array(c, kind)) ** 2).sum(axis=1) for c in centroids], axis=1)


@dataclass
class Assigned:
    """A part of a block: places in the batch, integer vectors, clusters and squared distances."""

    at: np.ndarray
    x: np.ndarray
    cluster: np.ndarray
    distance: np.ndarray


def assign(at: np.ndarray, x: np.ndarray, centroids: list[list[int]], scale: int) -> Iterator[Assigned]:
    """Blocks of nearest centroids, ties to the smaller number; rows of large numbers are apart from the others."""
    most = max((abs(v) for c in centroids for v in c), default=0)
    room = max(0, math.isqrt(EXACT_DOUBLE // max(1, x.shape[1])) - most - 1)
    with np.errstate(over="ignore"):
        small = _magnitude(x) * float(scale) < room * (1 - 1e-9)
    for rows in (np.flatnonzero(small), np.flatnonzero(~small)):
        for lo in range(0, len(rows), BLOCK):
            part = rows[lo : lo + BLOCK]
            y = whole_numbers(x[part], scale)
            d = distances(y, centroids)
            best = np.argmin(d, axis=1)
            yield Assigned(at[part], y, best, d[np.arange(len(part)), best])


#: By cluster: rows, sum of vectors, sum of distances; Python's integers, so sums of any number of rows are exact.
Sums = dict[int, tuple[int, list[int], int]]


def merged(a: Sums, b: Sums) -> Sums:
    out = dict(a)
    for k, (n, vector, distance) in b.items():
        if k in out:
            was = out[k]
            out[k] = (was[0] + n, [p + q for p, q in zip(was[1], vector)], was[2] + distance)
        else:
            out[k] = (n, vector, distance)
    return out


def _exact_sum(values: np.ndarray) -> list[int]:
    """Column sums of integers; 64-bit where they fit."""
    if values.dtype != object and len(values) * int(np.abs(values).max(initial=0)) < EXACT_LONG // 2:
        return values.astype("int64").sum(axis=0).tolist()
    return [sum(int(v) for v in column) for column in values.T]


def sums_of(part: Assigned) -> Sums:
    out: Sums = {}
    for k in np.unique(part.cluster).tolist():
        mine = part.cluster == k
        out[k] = (int(mine.sum()), _exact_sum(part.x[mine]), _exact_sum(part.distance[mine][:, None])[0])
    return out


def _packed(sums: Sums) -> list[tuple[int, int, list[str], str]]:
    return [(k, n, [str(v) for v in vector], str(distance)) for k, (n, vector, distance) in sums.items()]


_SUMS = pa.schema([("k", pa.int32()), ("n", pa.int64()), ("v", pa.list_(pa.string())), ("d", pa.string())])
_SUMS_SPARK = "k int, n long, v array<string>, d string"


def total(df: DataFrame, vector: str, centroids: list[list[int]], dims: int, scale: int) -> Sums:
    """Sums by nearest centroid over all of ``df``: in its tasks, then up a tree."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Sums = {}
        for batch in batches:
            for part in assign(*usable(batch.column(0), dims), centroids, scale):
                sums = merged(sums, sums_of(part))
        columns = list(zip(*_packed(sums))) or [[], [], [], []]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SUMS)], schema=_SUMS)

    partial = df.select(F.col(f"`{vector}`").alias("x")).mapInArrow(tasks, _SUMS_SPARK).rdd
    add: Callable[[Sums, T.Row], Sums] = lambda sums, row: merged(sums, {row.k: (row.n, [int(v) for v in row.v], int(row.d))})
    return partial.treeAggregate({}, add, merged, DEPTH)


def first_centroids(df: DataFrame, key: str, vector: str, k: int, dims: int, scale: int, seed: int) -> list[list[int]]:
    """The ``k`` usable vectors with the smallest sha256 of ``seed:key`` (rows with a null key come last; then by their components)."""
    x = F.col("x")
    good = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = df.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{key}`").cast("string")), 256).alias("h"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    first = rows.where(good).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return [[int(v) for v in row] for row in whole_numbers(np.array([r["x"] for r in first], "float64").reshape(len(first), dims), scale)]


def moved(centroids: list[list[int]], sums: Sums) -> list[list[int]]:
    """Floors of the means; centroids without a vector stay."""
    return [[v // sums[k][0] for v in sums[k][1]] if k in sums else c for k, c in enumerate(centroids)]


def _long(value: int) -> int | None:
    return value if value <= _LONGEST else None


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, dims: int = 64, rounds: int = 3, scale: int = 64, seed: int = 1) -> DataFrame:
    """Per usable vector: ``key``, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, have another length than ``dims``, or have a null or
    non-finite component are left out.  Components become floor(scale * x).  Ties go to
    the centroid with the smaller number.  Rows with equal or null keys are rows of
    their own.  With fewer than ``k`` vectors there are as many centroids; without any the
    result is empty.  A distance or a sum of distances beyond a long is null; all other
    numbers stay exact.  Other columns of ``df`` are ignored.
    """
    centroids = first_centroids(df, key, vector, k, dims, scale, seed)
    for _ in range(rounds):
        centroids = moved(centroids, total(df, vector, centroids, dims, scale))
    inertia = {c: d for c, (_, _, d) in total(df, vector, centroids, dims, scale).items()}
    whole = _long(sum(inertia.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    schema = T.StructType([df.select(F.col(f"`{key}`").alias(key)).schema[0], *T._parse_datatype_string("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")])
    names = schema.names

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not centroids:
                continue
            for part in assign(*usable(batch.column(1), dims), centroids, scale):
                clusters = part.cluster.tolist()
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(part.at)), pa.array(part.cluster, pa.int32()), pa.array([_long(int(d)) for d in part.distance], pa.int64()),
                        pa.array([_long(inertia[c]) for c in clusters], pa.int64()), pa.array([whole] * len(clusters), pa.int64()), pa.array([digests[c] for c in clusters], pa.string()),
                    ],
                    names=names,
                )

    return df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{vector}`").alias("x")).mapInArrow(label, schema)

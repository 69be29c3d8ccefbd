"""Centroid clustering against a loop over Python's integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from turnlake.llm import centroids


def brute(rows, k=16, dims=64, rounds=3, scale=64, seed=1):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [math.floor(Fraction(x) * scale) for x in v], v))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    c = [r[1] for r in order[:k]]

    def nearest(x):
        d = [sum((a - b) ** 2 for a, b in zip(x, y)) for y in c]
        return min((dd, i) for i, dd in enumerate(d))

    for _ in range(rounds):
        at = [nearest(x)[1] for _, x, _ in kept]
        for i in range(len(c)):
            mine = [x for (_, x, _), a in zip(kept, at) if a == i]
            if mine:
                c[i] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [nearest(x) for _, x, _ in kept]
    sums = {i: sum(d for d, a in last if a == i) for i in range(len(c))}
    fit = lambda v: v if v < 1 << 63 else None
    return sorted(
        [(key, i, fit(d), fit(sums[i]), fit(sum(sums.values())), hashlib.sha256(",".join(map(str, c[i])).encode()).hexdigest()) for (key, _, _), (d, i) in zip(kept, last)], key=str
    )


def got(df):
    return sorted([tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()], key=str)


def vectors(n, dims, seed, size=1.0):
    rnd = random.Random(seed)
    return [(i, [float(np.float32(rnd.gauss(0, size))) for _ in range(dims)]) for i in range(n)]


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 5) for r in rows], f"vec_id long, embedding array<{kind}>, cluster int").repartition(3)


@pytest.mark.parametrize("seed, size", [(1, 1.0), (2, 0.01), (3, 1e5)])
def test_equals_the_loop(spark, seed, size):
    rows = vectors(300, 64, seed, size)
    assert got(centroids.cluster(frame(spark, rows))) == brute(rows)


def test_awkward_rows(spark):
    """Nulls, wrong lengths, null and non-finite components, repeated rows and keys, ties, a null key."""
    rows = vectors(40, 4, 5) + [(100, None), (101, []), (102, [1.0]), (103, [1.0, None, 2.0, 3.0]), (104, [1.0, math.nan, 2.0, 3.0]), (105, [math.inf, 0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5, 0.5])]
    rows += [rows[0], rows[0], (7, [9.0, 9.0, 9.0, -9.0])] + [(200 + i, [0.25, -0.25, 0.0, 1.0]) for i in range(30)]
    for k in (1, 3, 16, 500):
        assert got(centroids.cluster(frame(spark, rows), k=k, dims=4)) == brute(rows, k=k, dims=4)
    assert got(centroids.cluster(frame(spark, []), dims=4)) == []
    assert got(centroids.cluster(frame(spark, [(1, None)]), dims=4)) == []


def test_beyond_doubles(spark):
    """Numbers whose squares pass 2^53, 2^63 and any double: exact, and null where a long can't hold the distance."""
    rnd = random.Random(8)
    rows = [(i, [rnd.choice([-1, 1]) * rnd.random() * 10.0 ** rnd.choice([0, 3, 6, 9, 17, 150, 308]) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, [float(rnd.randint(-(2**20), 2**20)) for _ in range(4)]) for i in range(60)]
    assert got(centroids.cluster(frame(spark, rows, "double"), k=5, dims=4)) == brute(rows, k=5, dims=4)
    near = [(i, [2.0**24 + i, -(2.0**25), 3.0, float(i % 3)]) for i in range(50)]
    assert got(centroids.cluster(frame(spark, near, "double"), k=4, dims=4)) == brute(near, k=4, dims=4)


def test_the_guard():
    """Blocks under the bound are doubles, others integers, at the very edge too; both agree."""
    for peak in (1 << 10, 1 << 24, (1 << 26) - 1, 1 << 26, 1 << 30, 1 << 40):
        x = np.array([[peak, -peak], [1, peak], [0, 0]], "float64")
        c = [[-peak, peak], [0, 1]]
        d = centroids.distances(x, c)
        assert (d.dtype == "float64") == (2 * (2 * peak) ** 2 < 1 << 53)
        assert [[int(v) for v in r] for r in d] == [[sum((int(a) - b) ** 2 for a, b in zip(row, y)) for y in c] for row in x]

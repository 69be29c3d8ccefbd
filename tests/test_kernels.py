"""Kernels against plain loops, and the plan of the whole pipeline."""

import math
import time

import numpy as np
import pytest

from turnlake.config import BinarizeConfig, PipelineConfig, VbxConfig
from turnlake.operators import kernels
from turnlake.plans import backend, pipeline
from turnlake.sources import audio


def plain_linkage(distance):
    d = {(i, j): float(distance[i, j]) ** 2 for i in range(len(distance)) for j in range(i + 1, len(distance))}
    n, size, name, alive, steps = len(distance), {}, {}, list(range(len(distance))), []
    for i in alive:
        size[i], name[i] = 1, i
    at = lambda i, j: d[min(i, j), max(i, j)]
    for step in range(n - 1):
        height, a, b = min((at(i, j), i, j) for i in alive for j in alive if i < j)
        steps.append((*sorted((name[a], name[b])), math.sqrt(max(height, 0))))
        for k in alive:
            if k not in (a, b):
                total = size[a] + size[b]
                d[min(a, k), max(a, k)] = (size[a] * at(a, k) + size[b] * at(b, k)) / total - size[a] * size[b] * height / total**2
        alive.remove(b)
        size[a], name[a] = size[a] + size[b], n + step
    return steps


@pytest.mark.parametrize("seed", range(6))
def test_linkage_equals_plain_search(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, (40, 2)).astype("float64") if seed < 2 else rng.standard_normal((40, 5))  # the first have many ties
    got, want = kernels.centroid_linkage(kernels.pairwise_distance(x)), plain_linkage(kernels.pairwise_distance(x))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_linkage_of_many_rows_takes_little_time():
    x = np.random.default_rng(1).standard_normal((10_000, 16)).astype("float32")
    began = time.perf_counter()
    labels = kernels.cluster_rows(x, 0.6)
    assert len(labels) == len(x) and time.perf_counter() - began < 60


def test_mixture_equals_plain_loops():
    rng = np.random.default_rng(5)
    x, phi = rng.standard_normal((30, 4)).astype("float32"), rng.uniform(0.5, 3, 4).astype("float32")
    start, c = kernels.initial_responsibilities(rng.integers(0, 3, 30)), VbxConfig(max_iters=3, epsilon=-1e9)
    gamma, prior = [[float(v) for v in row] for row in start], [1 / 3] * 3
    for _ in range(c.max_iters):
        ratio, logs = c.fa / c.fb, [[0.0] * 3 for _ in range(30)]
        for s in range(3):
            weight = sum(g[s] for g in gamma)
            inverse = [1 / (1 + ratio * weight * float(p)) for p in phi]
            alpha = [ratio * inverse[d] * sum(gamma[t][s] * float(x[t][d]) * math.sqrt(phi[d]) for t in range(30)) for d in range(4)]
            for t in range(30):
                fit = sum(float(x[t][d]) * math.sqrt(phi[d]) * alpha[d] - 0.5 * (inverse[d] + alpha[d] ** 2) * float(phi[d]) for d in range(4))
                logs[t][s] = c.fa * (fit - 0.5 * (sum(float(v) ** 2 for v in x[t]) + 4 * math.log(2 * math.pi))) + math.log(prior[s] + 1e-8)
        gamma = [[math.exp(v) / sum(map(math.exp, row)) for v in row] for row in logs]
        prior = [sum(g[s] for g in gamma) / 30 for s in range(3)]
    got, priors = kernels.vbx(x, phi, start, c)
    assert np.allclose(got, gamma, atol=1e-5) and np.allclose(priors, prior, atol=1e-5)


def test_filter_bank_equals_a_plain_transform():
    x = np.sin(np.arange(900) * 0.3) * 0.2 + np.random.default_rng(2).standard_normal(900) * 0.01
    bank, rows = audio.mel_bank(), []
    for at in range(0, 900 - 400 + 1, 160):
        frame = [float(v) * 32768 for v in x[at : at + 400]]
        mean = sum(frame) / 400
        frame = [v - mean for v in frame]
        frame = [v - 0.97 * frame[max(0, i - 1)] for i, v in enumerate(frame)]
        frame = [v * (0.54 - 0.46 * math.cos(2 * math.pi * i / 399)) for i, v in enumerate(frame)]
        power = [abs(sum(v * complex(math.cos(2 * math.pi * k * i / 512), -math.sin(2 * math.pi * k * i / 512)) for i, v in enumerate(frame))) ** 2 for k in range(257)]
        rows.append([math.log(max(float(np.finfo("float32").eps), sum(float(w) * p for w, p in zip(b, power)))) for b in bank])
    rows = np.array(rows)
    assert np.allclose(audio.filter_bank(x), rows - rows.mean(axis=0), atol=1e-3)


def test_models_and_clustering_run_once(spark, monkeypatch):
    saved = []
    monkeypatch.setattr(pipeline, "materialized", lambda df, name, keep=pipeline.materialized: (saved.append((name, df._jdf.queryExecution().executedPlan().toString())), keep(df, name))[1])
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, [float(v) for v in rng.standard_normal(2000) * 0.1]) for i in range(3)], "file_id long, samples array<float>")
    config = PipelineConfig(step=256 / 16_000, ahc_threshold=1.0, binarize=BinarizeConfig(min_on=2, min_off=2))
    result = pipeline.Pipeline(backend.StubBackend, kernels.Plda.synthetic(16, 8), config, window=512, frames_per_window=20).run(rows)
    saved.append(("segments", result.segments._jdf.queryExecution().executedPlan().toString()))
    models = sum(p.count("MapInPandas") for n, p in saved if n in ("segmentations", "embeddings"))
    assert models == 2 and sum("MapInPandas" in p for n, p in saved if n in ("segmentations", "embeddings")) == 2
    assert sum(p.count("FlatMapGroupsInPandas") for _, p in saved) == 1


@pytest.mark.parametrize("seed", range(4))
def test_linkage_of_rows_makes_the_same_merges(seed, monkeypatch):
    monkeypatch.setattr(kernels, "LINKAGE_BLOCK", 7)
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(60, 8))
    x[40:50] = x[:10]  # equal rows
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want, got = kernels.centroid_linkage(kernels.pairwise_distance(x)), kernels.linkage_of_rows(x)
    assert [s[:2] for s in got] == [s[:2] for s in want] and np.allclose([s[2] for s in got], [s[2] for s in want], atol=1e-6)
    for threshold in (0.0, 0.3, 0.8, 1.2):
        assert kernels.flat_labels(60, got, threshold).tolist() == kernels.flat_labels(60, want, threshold).tolist()


def test_linkage_memory_is_linear():
    import tracemalloc

    peaks = []
    for n in (500, 2000):
        x = np.random.default_rng(1).normal(size=(n, 16)).astype("float32")
        tracemalloc.start()
        assert len(kernels.linkage_of_rows(x)) == n - 1
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 6 * peaks[0] and peaks[1] < 2000 * 2000 * 8


def test_heights_are_compared_in_single_precision():
    assert kernels.flat_labels(2, [(0, 1, 0.6000000000001)], 0.6).tolist() == [0, 0]
    assert kernels.flat_labels(2, [(0, 1, 0.60001)], 0.6).tolist() == [0, 1]


def test_rows_are_scaled_in_double_precision():
    # 0 - 1 is longer than 1 - 2 by 1e-8, which single precision turns round
    x = np.array([[1.327788233757019, 0.0], [1.0752841234207153, 0.35452577471733093], [6.034252643585205, 4.464332580566406]], "float32")
    assert kernels.cluster_rows(x, 0.4).tolist() == [0, 1, 1]

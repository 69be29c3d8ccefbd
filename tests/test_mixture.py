"""Mixture inference over slices against the kernel of one recording, learnt PLDA against plain loops."""

import math

import numpy as np
import pytest

from turnlake.config import VbxConfig
from turnlake.operators import kernels, mixture

PHI = np.array([3.0, 2.0, 1.5, 0.7], "float32")


def recordings(seed=3):
    rng = np.random.default_rng(seed)
    out = {}
    for file_id, (n, k) in {"a": (70, 3), "b": (41, 5), "c": (1, 1), "d": (30, 2)}.items():
        centres = rng.normal(0, 3, (k, 4))
        label = np.r_[np.arange(k), rng.integers(0, k, n - k)]
        out[file_id] = ((centres[label] + rng.normal(0, 1, (n, 4))).astype("float32"), np.where(rng.random(n) < 0.2, 0, label) if file_id != "d" else label * 3)
    return out


def table(spark, data, extra=()):
    rows = [(f, i, int(l), [float(v) for v in r], "x") for f, (x, label) in data.items() for i, (r, l) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows + list(extra), "file_id string, vec_id long, label int, features array<float>, moment string")


@pytest.mark.parametrize("config", [VbxConfig(epsilon=0.05), VbxConfig(max_iters=1), VbxConfig(max_iters=3, init_smoothing=-1)])
def test_slices_give_what_the_kernel_gives(spark, config):
    data = recordings()
    # rows that can't take part
    nan = float("nan")
    extra = [("a", 900, None, [0.0] * 4, None), ("a", 901, 0, None, None), ("a", 902, -1, [0.0] * 4, None), ("a", 903, 0, [0.0] * 3, None), ("a", 904, 0, [nan, 0.0, 0.0, 0.0], None), ("e", 1, None, None, None), (None, 1, 0, [0.0] * 4, None), ("a", None, 0, [0.0] * 4, None)]
    found = mixture.posteriors(table(spark, data, extra), PHI, config, slice_rows=8)
    rows, speakers = {}, {}
    for r in found.rows.collect():
        rows.setdefault(r["file_id"], {})[r["vec_id"]] = r["gamma"]
    for r in found.speakers.collect():
        speakers.setdefault(r["file_id"], {})[r["speaker"]] = (r["prior"], r["turns"])
    assert set(rows) == set(speakers) == set(data)
    for file_id, (x, label) in data.items():
        trace = []
        gamma, prior = kernels.vbx(x, PHI, kernels.initial_responsibilities(label, config.init_smoothing), config, trace)
        assert sorted(rows[file_id]) == list(range(len(x)))
        assert np.allclose([rows[file_id][i] for i in range(len(x))], gamma, atol=1e-5)
        assert np.allclose([speakers[file_id][k][0] for k in range(len(prior))], prior, atol=1e-5)
        assert {t for _, t in speakers[file_id].values()} == {len(trace)}


def test_recordings_stop_on_their_own(spark):
    turns = {r["file_id"]: r["turns"] for r in mixture.posteriors(table(spark, recordings()), PHI, VbxConfig(epsilon=0.05), slice_rows=8).speakers.collect()}
    assert len(set(turns.values())) > 1


def test_no_rows(spark):
    found = mixture.posteriors(table(spark, {}), PHI)
    assert found.rows.columns == ["file_id", "vec_id", "gamma"] and found.rows.count() == 0 and found.speakers.count() == 0
    with pytest.raises(ValueError):
        mixture.posteriors(table(spark, {}), PHI, VbxConfig(max_iters=0))


def test_turns_move_models_and_not_rows(spark, monkeypatch):
    plans = []
    keep = mixture.materialized
    monkeypatch.setattr(mixture, "materialized", lambda df, name: (plans.append(df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")) if name == "mixture-models" else ""), keep(df, name))[1])
    mixture.posteriors(table(spark, recordings()), PHI, VbxConfig(max_iters=2), slice_rows=8)
    turns = [p for p in plans if "FlatMapCoGroupsInPandas" in p]
    assert len(turns) == 2
    for plan in turns:  # the rows' exchange and sort are those of the stored table
        at = plan[plan.index("FlatMapCoGroupsInPandas") :]
        above = at[: at.index("InMemoryRelation")]
        assert "Exchange" not in above and "Sort" not in above


def labelled(n=120, dims=6, seed=5):
    rng = np.random.default_rng(seed)
    label = np.r_[np.arange(4), rng.integers(0, 4, n - 4)]
    return (rng.normal(0, 2, (4, dims))[label] + rng.normal(0, 1, (n, dims))).astype("float32"), label


def plain_estimate(x, label, out):
    """Means, directions, spread within and between labels, in loops over lists."""
    scaled = lambda v: [c * math.sqrt(len(v)) / math.sqrt(sum(a * a for a in v)) for c in v]
    mean = lambda rows: [sum(r[d] for r in rows) / len(rows) for d in range(len(rows[0]))]
    x = [[float(v) for v in r] for r in x]
    mean1 = mean(x)
    u = [scaled([v - m for v, m in zip(r, mean1)]) for r in x]
    size = {c: sum(int(v) == c for v in label) for c in set(map(int, label))}
    heads = sorted(size, key=lambda c: (-size[c], c))[:out]
    directions = [mean([r for r, v in zip(u, label) if v == c]) for c in heads]
    p = [[sum(a * b for a, b in zip(r, d)) for d in directions] for r in u]
    mean2 = mean(p)
    y = [scaled([v - m for v, m in zip(r, mean2)]) for r in p]
    own = {c: mean([r for r, v in zip(y, label) if v == c]) for c in size}
    mu = mean(y)
    within = [sum((r[d] - own[int(v)][d]) ** 2 for r, v in zip(y, label)) / len(y) for d in range(len(mu))]
    between = [sum((own[int(v)][d] - mu[d]) ** 2 for v in label) / len(y) for d in range(len(mu))]
    order = sorted(range(len(mu)), key=lambda d: -between[d] / within[d])
    return [between[d] / within[d] for d in order], [[abs((r[d] - mu[d]) / math.sqrt(within[d])) for d in order] for r in y]


@pytest.mark.parametrize("out", [2, 3, 16])
def test_learnt_plda_equals_plain_loops(spark, out):
    x, label = labelled()
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, label))]
    bad = [(200, None, 1), (201, [1.0] * 6, None), (202, [1.0] * 5, 0), (203, [float("inf")] + [0.0] * 5, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    plda = mixture.estimate_plda(df, out)
    phi, want = plain_estimate(x, label, out)
    assert np.allclose(plda.phi, phi, rtol=1e-8)
    got = {r["vec_id"]: r["f"] for r in df.select("vec_id", mixture.plda_features(plda)("embedding").alias("f")).collect()}
    assert got[200] is None and got[202] is None and got[201] is not None
    assert np.allclose(np.abs([got[i] for i in range(len(x))]), want, atol=1e-4)


@pytest.mark.parametrize("labels", [[0, 0, 0, 0], [0, 1, 2, 3]])
def test_labels_without_spread_are_an_error(spark, labels):
    rows = [(i, [float(v) for v in np.random.default_rng(i).normal(size=3)], c) for i, c in enumerate(labels)]
    with pytest.raises(kernels.PldaError):
        mixture.estimate_plda(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))


def test_no_labelled_rows_are_an_error(spark):
    with pytest.raises(kernels.PldaError):
        mixture.estimate_plda(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))


@pytest.mark.parametrize("seed", range(4))
def test_eigenproblem_holds_for_any_transform(seed):
    """Residual of each pair and orthogonality, whatever the sign of vectors; for a square transform its rows solve it, by falling psi."""
    rng = np.random.default_rng(seed)
    n = 9
    tr, psi = np.eye(n) + 0.3 * rng.standard_normal((n, n)), rng.uniform(0.2, 5, n)
    plda = kernels.Plda.derive(np.zeros(12), np.zeros(n), rng.standard_normal((12, n)), np.zeros(n), tr, psi)
    within, between = np.linalg.inv(tr.T @ tr), np.linalg.inv((tr.T / psi) @ tr)
    v = plda.transform.T
    assert np.abs(between @ v - within @ v * plda.phi).max() < 1e-8
    assert np.allclose(v.T @ within @ v, np.eye(n), atol=1e-8)
    order = np.argsort(-psi)
    assert np.allclose(plda.phi, psi[order]) and np.allclose(np.abs(plda.transform), np.abs(tr[order]))

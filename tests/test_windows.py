"""The pipeline on rows of windows gives what it gives on rows of frames."""

import numpy as np
import pytest

from turnlake.config import BinarizeConfig, PipelineConfig
from turnlake.operators import frames, kernels, layout, masks, powerset, smoothing
from turnlake.plans import backend, pipeline
from turnlake.sources import wav_ranges

WINDOW, FRAMES = 512, 20


def recordings(n=6):
    rnd = np.random.default_rng(5)
    sizes = rnd.integers(400, 9000, n)
    return [(f"r{i}", (rnd.standard_normal(s) * np.repeat(rnd.uniform(0, 0.4, s // 100 + 1), 100)[:s]).astype("float32").tolist()) for i, s in enumerate(sizes)] + [("short", [0.0] * 10), ("still", [0.0] * 2000)]


def plain(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("config", [{}, {"smoothing": None}, {"binarize": BinarizeConfig(min_on=2, min_off=2)}])
def test_windows_give_what_frames_give(spark, monkeypatch, config):
    monkeypatch.setattr(pipeline, "SHORT_WINDOWS", 20)  # some recordings are a kernel of their own
    monkeypatch.setattr(pipeline, "KERNEL_WINDOWS", 16)
    rows = spark.createDataFrame(recordings(), "file_id string, samples array<float>")
    c, plda = PipelineConfig(step=256 / 16_000, ahc_threshold=1.0, **config), kernels.Plda.synthetic(16, 8)
    got = pipeline.Pipeline(backend.StubBackend, plda, c, window=WINDOW, frames_per_window=FRAMES).run(rows)
    found = got.artifacts
    want = pipeline.post_inference(pipeline.Artifacts(found.segmentations, found.embeddings).stored(), plda, c)
    assert plain(want.segments, "file_id", "start", "end", "speaker") == plain(got.segments, "file_id", "start", "end", "speaker") != []
    for name, columns in (("counts", ("out_frame", "n_speakers")), ("clusters", ("chunk_idx", "speaker_idx", "cluster")), ("activations", ("out_frame", "cluster", "score")), ("discrete", ("out_frame", "cluster", "score", "active"))):
        assert plain(getattr(want, name), "file_id", *columns) == plain(getattr(got, name), "file_id", *columns)


def test_windows_hold_what_models_gave(spark):
    step = 256
    rows = spark.createDataFrame(recordings(), "file_id string, samples array<float>")
    runs = layout.runs(rows, WINDOW, step, wav_ranges.RUN)
    model = pipeline.Pipeline(backend.StubBackend, None, PipelineConfig(step=step / 16_000), window=WINDOW, frames_per_window=FRAMES)
    found = model.infer(runs)
    seg = powerset.decode(backend.segment(runs, backend.StubBackend, WINDOW, step), 3, 2).select("file_id", "chunk_idx", "frame_idx", "speaker_idx", "active").cache()
    columns = ("file_id", "chunk_idx", "frame_idx", "speaker_idx", "active")
    assert plain(seg, *columns) == plain(found.segmentations, *columns)
    weights = {(r.file_id, r.chunk_idx, r.speaker_idx): r for r in masks.speaker_weights(seg, WINDOW).collect()}
    there = {(r.file_id, r.chunk_idx, r.speaker_idx) for r in found.embeddings.where("embedding is not null").collect()}
    assert there == {k for k, r in weights.items() if r.weight >= 10} != set()
    training = {(r.file_id, r.chunk_idx, s) for r in found.windows.collect() for s in range(3) if r.training[s]}
    assert training == {(r.file_id, r.chunk_idx, r.speaker_idx) for r in masks.training_set(seg, found.embeddings).collect()} != set()


def test_frames_without_a_speaker_are_no_rows(spark, monkeypatch):
    kept = {}
    for module in (frames, smoothing, pipeline):
        monkeypatch.setattr(module, "materialized", lambda df, name, keep=module.materialized: kept.setdefault(name, keep(df, name)))
    rows = spark.createDataFrame(recordings(), "file_id string, samples array<float>")
    model = pipeline.Pipeline(backend.StubBackend, kernels.Plda.synthetic(16, 8), PipelineConfig(step=256 / 16_000, ahc_threshold=1.0), window=WINDOW, frames_per_window=FRAMES)
    result = model.run(rows)
    spoken = result.counts.where("n_speakers > 0").count()
    assert 0 < spoken < result.counts.count() / 5
    assert kept["frames"].count() == spoken


def test_short_recordings_share_kernels(spark, monkeypatch):
    monkeypatch.setattr(pipeline, "KERNEL_WINDOWS", 1 << 20)
    rows = spark.createDataFrame([(i, [0.01 * (i + k % 7) for k in range(1024)]) for i in range(50)], "file_id long, samples array<float>")
    model = pipeline.Pipeline(backend.StubBackend, kernels.Plda.synthetic(16, 8), PipelineConfig(step=256 / 16_000, ahc_threshold=1.0), window=WINDOW, frames_per_window=FRAMES)
    windows = model.infer(model.runs(rows)).windows
    found = pipeline.cluster_windows(windows, model.plda, model.config)
    assert found.count() == 200 and found.selectExpr("spark_partition_id() as p").distinct().count() == 1


def test_ranges_of_many_short_files_share_partitions():
    files = [(f"f{i}", 2092) for i in range(50_000)]
    ranges = wav_ranges.plan(files, 65_537)
    shared = wav_ranges.bundled(ranges, 24)
    assert len(ranges) > 1500 and 24 <= len(shared) < 27
    assert [p for r in shared for p in r.parts] == [p for r in ranges for p in r.parts]
    few = wav_ranges.plan(files[:100], 65_537)
    assert wav_ranges.bundled(few, 24) == few
    big = wav_ranges.plan([("x", 100 << 30)], wav_ranges.RANGE_BYTES)
    assert wav_ranges.bundled(big, 24) == big


def test_mixtures_of_one_shape_together_are_those_one_by_one():
    rnd = np.random.default_rng(6)
    phi = rnd.uniform(0.5, 4, 8)
    xs = rnd.standard_normal((30, 7, 8)) * rnd.uniform(0.3, 4, (30, 1, 1))  # some settle before others
    starts = np.stack([kernels.initial_responsibilities(np.r_[0, 1, 2, rnd.integers(0, 3, 4)]) for _ in xs])
    turns = []
    for x, start, gamma, prior in zip(xs, starts, *kernels.vbx_many(xs, phi, starts)):
        trace = []
        want = kernels.vbx(x, phi, start, trace=trace)
        turns.append(len(trace))
        assert np.allclose(gamma, want[0], atol=1e-6) and np.allclose(prior, want[1], atol=1e-6)
    assert len(set(turns)) > 1

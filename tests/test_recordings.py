"""Recordings by byte ranges, one model pass per run of windows, files with one commit."""

import collections
import os
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnlake.config import PipelineConfig
from turnlake.operators import kernels, layout
from turnlake.plans import backend, pipeline
from turnlake.sources import audio, file_sink, wav_ranges


def wav(n, seed=0, rate=16_000, extra=b""):
    """A PCM file of n samples; ``extra`` is a chunk before the data, padded if odd."""
    body = np.random.default_rng(seed).integers(-32768, 32768, n).astype("<i2").tobytes()
    chunk = b"LIST" + struct.pack("<I", len(extra)) + extra + b"\0" * (len(extra) % 2) if extra else b""
    form = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(chunk) + len(body)) + b"WAVE" + form + chunk + b"data" + struct.pack("<I", len(body)) + body


FILES = {
    "a": wav(1000, 1), "b": wav(301, 2, extra=b"odd"), "c": wav(300, 3), "d": wav(299, 4), "e": wav(0), "f": wav(77, 5), "cut": wav(500, 6)[:-101],
    "noise": b"nothing of the sort", "stereo": wav(10)[:22] + b"\2" + wav(10)[23:], "none": b"",
}


def all_windows(raw, window, step):
    samples, _ = audio.decode_wav(raw)
    n = wav_ranges.window_count(len(samples), window, step)
    return [(i, samples[i * step : i * step + window].tolist()) for i in range(n)]


@pytest.mark.parametrize("window, step, run", [(100, 30, 4), (100, 100, 1), (64, 7, 3)])
def test_windows_are_the_same_wherever_files_are_cut(window, step, run):
    sizes = [(name, len(raw)) for name, raw in FILES.items()]
    for range_bytes in [1, 2, 3, 5, 17, 44, 45, 46, 101, 333, 1999, 10**6]:
        parts = [p for r in wav_ranges.plan(sizes, range_bytes) for p in r.parts]
        assert all(sum(hi - lo for _, _, lo, hi in r.parts) <= range_bytes for r in wav_ranges.plan(sizes, range_bytes))
        for name, raw in FILES.items():
            mine = [p for p in parts if p[0] == name]
            assert mine[0][2] == 0 and mine[-1][3] == max(1, len(raw)) and all(x[3] == y[2] for x, y in zip(mine, mine[1:]))
            for pieces in (False, True):
                if pieces and window != step:
                    continue
                of = wav_ranges._Layout(window, step, run, pieces)
                reads = []

                def fetch(at, n, raw=raw, reads=reads):
                    reads.append(n)
                    return raw[at : at + n]

                rows = [row for _, size, lo, hi in mine for row in wav_ranges.read_part(fetch, size, lo, hi, of, None)]
                if name in ("noise", "stereo", "none"):
                    assert len(rows) == 1 and rows[0][-1]
                    continue
                assert max(reads) <= max(16, 2 * ((run - 1) * step + window))
                assert [r[0] for r in rows] == list(range(len(rows)))
                samples, rate = audio.decode_wav(raw)
                assert all(r[4] == len(samples) and r[5] == rate for r in rows)
                if pieces:
                    assert np.concatenate([r[6] for r in rows]).tolist() == samples.tolist() and len(rows) >= 1
                else:
                    got = [(first + i, x[i * step : i * step + window].tolist()) for _, first, n, _, _, _, x, _ in rows for i in range(n)]
                    assert got == all_windows(raw, window, step)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("wavs")
    for name, raw in FILES.items():
        (path / f"{name}.wav").write_bytes(raw)
    (path / "deep").mkdir()
    (path / "deep" / "g.wav").write_bytes(wav(5000, 9))
    (path / "other.txt").write_bytes(b"x")
    return str(path)


def test_source(spark, folder):
    rows = wav_ranges.read_runs(spark, folder, 100, 30, run=4, rangeBytes=501)
    found = rows.collect()
    assert {r.file_id for r in found if r.error} == {"noise", "stereo", "none"}
    by = {}
    for r in found:
        if not r.error:
            by.setdefault(r.file_id, []).extend((r.chunk_idx + i, list(r.samples[i * 30 : i * 30 + 100])) for i in range(r.chunks))
    want = {name: all_windows(raw, 100, 30) for name, raw in (FILES | {"g": wav(5000, 9)}).items() if name not in ("noise", "stereo", "none")}
    assert {k: sorted(v) for k, v in by.items()} == {k: v for k, v in want.items() if v}
    assert rows.rdd.getNumPartitions() > 20 and max(len(r.samples or []) for r in found) <= 3 * 30 + 100
    assert {r.file_id for r in wav_ranges.read_runs(spark, folder, 100, rate=8_000).where("error like '%8000%'").collect()} >= {"a", "b"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = wav_ranges.read_runs(spark, folder, 100, 30, run=4, rangeBytes=501)
        assert rows.where("file_id in ('a', 'g')").where("file_id = 'a'").rdd.getNumPartitions() <= 5
        assert {r.file_id for r in rows.where("file_id in ('a', 'g') and chunk_idx > 8").select("file_id").distinct().collect()} == {"a", "g"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="pieces"):
        wav_ranges.read_runs(spark, folder, 100, 30, pieces=True).collect()


def test_runs_of_rows_hold_the_same_windows(spark):
    data = [(i, np.random.default_rng(i).random(n).astype("float32").tolist(), "x") for i, n in enumerate([0, 99, 100, 101, 130, 1000])] + [(9, None, "y")]
    got = {}
    for r in layout.runs(spark.createDataFrame(data, "file_id int, samples array<float>, note string"), 100, 30, 4).collect():
        assert r.note == "x" and r.chunk_idx == 4 * r.run_idx and len(r.samples) <= 3 * 30 + 100
        got.setdefault(r.file_id, []).extend((r.chunk_idx + i, list(r.samples[i * 30 : i * 30 + 100])) for i in range(r.chunks))
    for i, samples, _ in data[:-1]:
        n = wav_ranges.window_count(len(samples), 100, 30)
        assert sorted(got.get(i, [])) == [(k, samples[k * 30 : k * 30 + 100]) for k in range(n)]


@pytest.mark.parametrize("step", [160, 480, 100])
def test_filter_banks_of_a_run_are_those_of_its_windows(step):
    x = np.random.default_rng(3).normal(0, 0.1, 3000).astype("float32")
    got = audio.run_filter_banks(x, 12, 1600, step)
    padded = np.r_[x, np.zeros(5000, "float32")]
    assert got.shape == (12, 8, 80)
    for i in range(12):
        assert np.allclose(got[i], audio.filter_bank(padded[i * step : i * step + 1600]), atol=1e-4)
    assert audio.run_filter_banks(x, 2, 100, 160).shape == (2, 0, 80)


def counting(path):
    """A backend that notes each window that features are made of, in files, as workers share nothing else."""

    class Counting(backend.StubBackend):
        def features(self, samples, windows, window, step):
            with open(f"{path}/{os.getpid()}", "a") as f:
                f.write(f"{windows} {len(samples)}\n")
            return super().features(samples, windows, window, step)

    return Counting


def test_features_are_made_once_for_all_masks(spark, tmp_path):
    rnd = np.random.default_rng(1)
    audio_rows = [(i, rnd.normal(0, 0.3, 600 + 200 * i).astype("float32").tolist()) for i in range(3)]
    window, step, run = 200, 50, 4
    runs = layout.runs(spark.createDataFrame(audio_rows, "file_id int, samples array<float>"), window, step, run)
    masks = []
    for i, x in audio_rows:
        for c in range(wav_ranges.window_count(len(x), window, step)):
            masks += [(i, c, s, (rnd.random(40) * (s < 2 or c % 2)).tolist()) for s in range(3)]
    table = spark.createDataFrame(masks, "file_id int, chunk_idx int, speaker_idx int, mask array<double>").repartition(5)
    path = str(tmp_path)
    found = backend.embed(runs, table, counting(path), window, step, run, min_activity=1.0).collect()
    assert len(found) == len(masks)
    model = backend.StubBackend()
    got = {(r.file_id, r.chunk_idx, r.speaker_idx): r.embedding for r in found}
    for i, c, s, mask in masks:
        x = np.zeros(window, "float32")
        part = audio_rows[i][1][c * step : c * step + window]
        x[: len(part)] = part
        want = model.embed(model._energy(x[None]), np.array([mask]))[0] if sum(mask) >= 1 else None
        assert (got[i, c, s] is None) == (want is None) and (want is None or np.allclose(got[i, c, s], want, atol=1e-5))
    notes = [tuple(map(int, line.split())) for name in os.listdir(path) for line in open(f"{path}/{name}")]
    assert sum(n for n, _ in notes) == sum(wav_ranges.window_count(len(x), window, step) for _, x in audio_rows)
    assert max(size for _, size in notes) <= (run - 1) * step + window


def test_pipeline_of_files_is_that_of_rows(spark, tmp_path):
    rnd = np.random.default_rng(2)
    rows = [(f"r{i}", (np.sin(np.arange(6000 + 999 * i) / (5 + i)) * rnd.random(6000 + 999 * i)).astype("float32")) for i in range(2)]
    for name, x in rows:
        (tmp_path / f"{name}.wav").write_bytes(audio.encode_wav(x))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    read = [(name, audio.decode_wav((tmp_path / f"{name}.wav").read_bytes())[0].tolist()) for name, _ in rows]
    p = pipeline.Pipeline(backend.StubBackend, kernels.Plda.synthetic(16, 8), PipelineConfig(step=0.064, ahc_threshold=1.0), window=2048, frames_per_window=20)
    a = sorted(map(tuple, p.run(spark.createDataFrame(read, "file_id string, samples array<float>")).segments.collect()))
    b = sorted(map(tuple, p.run_files(spark, str(tmp_path), rangeBytes=1001).segments.collect()))
    assert a == b and a


# ---- sink


def batch(*rows):
    return pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], names=["name", "content"])


def test_a_retried_task_leaves_one_file(tmp_path):
    w = file_sink.Writer(str(tmp_path))
    lost = w.write(iter([batch(("x", b"half"))]))
    first = w.write(iter([batch(("x", b"one\n"), ("x", b"two\n")), batch(("x", b"three\n"), ("y", None))]))
    second = w.write(iter([batch(("z", b"z"))]))
    assert os.listdir(tmp_path) == [w.stage]
    w.commit([first, second, None])
    assert lost.folder != first.folder and sorted(os.listdir(tmp_path)) == ["x", "y", "z"]
    assert (tmp_path / "x").read_bytes() == b"one\ntwo\nthree\n" and (tmp_path / "y").read_bytes() == b""
    w = file_sink.Writer(str(tmp_path))
    w.abort([w.write(iter([batch(("x", b"new"))]))])
    assert (tmp_path / "x").read_bytes() == b"one\ntwo\nthree\n" and len(os.listdir(tmp_path)) == 3
    w = file_sink.Writer(str(tmp_path))
    with pytest.raises(ValueError, match="several places"):
        w.commit([w.write(iter([batch(("q", b"1"))])), w.write(iter([batch(("q", b"2"))]))])
    for name in ("", None, "a/b", "_x", ".x"):
        with pytest.raises(ValueError, match="no file name"):
            file_sink.Writer(str(tmp_path)).write(iter([batch((name, b""))]))


def test_annotation_files(spark, tmp_path):
    rnd = random.Random(3)
    turns = [(f"rec{rnd.randrange(5) if i % 3 else 0}", i / 7, i / 7 + 1, rnd.choice("AB")) for i in range(300)]
    rnd.shuffle(turns)
    df = spark.createDataFrame(turns, "file_id string, start double, end double, speaker string").repartition(6)
    file_sink.write_annotations(df, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == [f"rec{i}.rttm" for i in range(5)]
    by = collections.defaultdict(list)
    for t in sorted(turns, key=lambda t: (t[1], t[2], t[3])):
        by[t[0]].append(f"SPEAKER {t[0]} 1 {t[1]:.6f} {t[2] - t[1]:.6f} <NA> <NA> {t[3]} <NA> <NA>\n")
    assert {name: open(tmp_path / "out" / f"{name}.rttm").read() for name in by} == {k: "".join(v) for k, v in by.items()}
    broken = df.withColumn("speaker", F.when(F.col("start") > 20, F.raise_error(F.lit("lost"))).otherwise(F.col("speaker")))
    with pytest.raises(Exception, match="lost"):
        file_sink.write_annotations(broken, str(tmp_path / "none"))
    assert not os.path.exists(tmp_path / "none") or os.listdir(tmp_path / "none") == []


def test_energies_take_a_recording_at_a_time(spark):
    samples = np.random.default_rng(3).uniform(-0.5, 0.5, 1000)
    rows = [(1, audio.encode_wav(samples)), (2, audio.encode_wav(samples[:100])), (3, b"no wave"), (4, None)]
    got = audio.energies(spark.createDataFrame(rows, "file_id long, content binary"))
    # one pass: samples don't leave the worker that reads them
    assert got._jdf.queryExecution().executedPlan().toString().count("Python") + got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.file_id: r for r in got.collect()}
    logs = audio.log_mel(audio.decode_wav(rows[0][1])[0])
    assert (got[1].frames, got[1].bins, got[1].error) == (*logs.shape, None) and got[1].energy == pytest.approx(float(logs.sum()))
    assert (got[2].frames, got[2].energy) == (0, 0.0)
    assert got[3].error and got[4].error and got[3].energy is None

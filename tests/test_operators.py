import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.config import BinarizeConfig, PipelineConfig, VbxConfig, window_step
from turnlake.functions import vectors
from turnlake.operators import binarize, errors, frames, intervals, kernels, layout, masks, powerset, selection, smoothing, turns
from turnlake.plans import backend, pipeline
from turnlake.sources import annotations, audio
from turnlake.streaming import queue

SEG = "file_id int, side string, speaker string, s_ms long, e_ms long"


def scores(spark, *tracks):
    rows = [(0, k, i, float(s)) for k, track in enumerate(tracks) for i, s in enumerate(track)]
    return spark.createDataFrame(rows, "file_id int, speaker int, frame int, score double")


def on(df):
    return [r.on for r in df.orderBy("speaker", "frame").collect()]


# ---- hysteresis and runs


@pytest.mark.parametrize(
    "track, config, want",
    [
        ([0.45, 0.55, 0.45, 0.55, 0.45], BinarizeConfig(0.6, 0.4), [0, 0, 0, 0, 0]),
        ([0, 0.7, 0.5, 0.5, 0.3, 0], BinarizeConfig(0.6, 0.4), [0, 1, 1, 1, 0, 0]),
        ([0, 0.8, 0, 0.8, 0.8, 0.8, 0], BinarizeConfig(min_on=3), [0, 0, 0, 1, 1, 1, 0]),
        ([0.8, 0.8, 0, 0.8, 0.8], BinarizeConfig(min_off=2), [1, 1, 1, 1, 1]),
        ([0, 0, 0, 0.8, 0.8, 0, 0, 0], BinarizeConfig(pad_onset=2, pad_offset=1), [0, 1, 1, 1, 1, 1, 0, 0]),
        ([0.55, 0.55, 0.55, 0.2], BinarizeConfig(0.5, 0.6), [1, 0, 1, 0]),
        ([0.9, float("nan"), 0.1], BinarizeConfig(), [1, 1, 0]),
    ],
)
def test_binarize_vectors(spark, track, config, want):
    assert on(binarize.binarize(scores(spark, track), config)) == want


def brute_binarize(track, c):
    state, out = 0, []
    for s in track:
        state = (0 if s < c.offset else 1) if state else int(s >= c.onset)
        out.append(state)

    def runs(x, v):
        return [(k[0][0], k[-1][0] + 1) for val, k in ((val, list(g)) for val, g in itertools.groupby(enumerate(x), key=lambda p: p[1])) if val == v]

    for a, b in runs(out, 1):
        if b - a < c.min_on:
            out[a:b] = [0] * (b - a)
    for a, b in runs(out, 0):
        if a > 0 and b < len(out) and b - a < c.min_off:
            out[a:b] = [1] * (b - a)
    padded = list(out)
    for a, b in runs(out, 1):
        for i in range(max(0, a - c.pad_onset), min(len(out), b + c.pad_offset)):
            padded[i] = 1
    return padded


def test_binarize_random(spark):
    rnd = random.Random(2)
    tracks = [[rnd.random() for _ in range(rnd.randint(1, 60))] for _ in range(40)]
    for c in (BinarizeConfig(0.6, 0.4, 3, 2, 1, 2), BinarizeConfig(0.4, 0.6, 2, 3, 2, 0)):
        got = {}
        for r in binarize.binarize(scores(spark, *tracks), c).orderBy("frame").collect():
            got.setdefault(r.speaker, []).append(r.on)
        assert [got[i] for i in range(len(tracks))] == [brute_binarize(t, c) for t in tracks]


# ---- turns


def test_turn_vectors(spark):
    a = turns.from_frames(scores(spark, [0, 1, 1, 1, 0]), 0.1, 0.2).collect()
    assert [(r.speaker, round(r.start, 9), round(r.end, 9)) for r in a] == [(0, 0.2, 0.5)]
    b = turns.from_frames(scores(spark, [0, 0, 1, 1], [1, 1, 0, 0]), 0.1, 0.2).orderBy("start").collect()
    assert [(turn.speaker, round(turn.start, 9)) for turn in b] == [(1, 0.1), (0, 0.3)]
    tail = turns.from_frames(scores(spark, [0, 0, 1]), 0.1, 0.2).collect()
    assert [(round(r.start, 9), round(r.end, 9)) for r in tail] == [(0.3, 0.3)]
    held = turns.from_frames(scores(spark, [0.5, 0.9, 0.5, float("nan"), 0.1]), 0.1, 0.2).collect()
    assert [(round(r.start, 9), round(r.end, 9)) for r in held] == [(0.2, 0.5)]
    assert turns.from_frames(scores(spark, [])).count() == 0


def test_merge(spark):
    def merged(rows, gap):
        df = spark.createDataFrame([(0, *r) for r in rows], "file_id int, speaker string, start double, end double")
        return [(r.speaker, r.start, r.end) for r in turns.merge(df, gap).orderBy("start").collect()]

    assert merged([("A", 0.0, 1.0), ("A", 1.05, 2.0)], 0.1) == [("A", 0.0, 2.0)]
    assert len(merged([("A", 0.0, 1.0), ("A", 2.0, 3.0)], 0.1)) == 2
    assert len(merged([("A", 0.0, 1.0), ("A", 1.0, 2.0)], 0.0)) == 2
    assert len(merged([("A", 0.0, 1.0), ("B", 0.5, 0.9), ("A", 1.0, 2.0)], 5.0)) == 3
    assert merged([("A", 0.0, 9.0), ("A", 1.0, 2.0)], 1.0) == [("A", 0.0, 2.0)]


# ---- annotation formats


def test_rttm(spark):
    text = ["SPEAKER a 1 1.5 3.0 <NA> <NA> S0 <NA> <NA>", "  SPEAKER\tb 1  2 x <NA> <NA> S1", "LEXEME a 1 0 1 <NA> <NA> S0", "SPEAKER c 1 0 1", ""]
    lines = spark.createDataFrame([(t,) for t in text], "value string")
    got = annotations.parse_rttm(lines).collect()
    assert [(r.file_id, r.start, r.end, r.speaker) for r in got] == [("a", 1.5, 4.5, "S0")]
    assert sorted(r.file_id for r in annotations.parse_rttm(lines, least=5).collect()) == ["a", "c"]
    assert annotations.parse_rttm(lines, duration=True).first().duration == 3.0
    turn = spark.createDataFrame([("meeting", 1.5, 4.5, "SPEAKER_00")], "file_id string, start double, end double, speaker string")
    want = "SPEAKER meeting 1 1.500000 3.000000 <NA> <NA> SPEAKER_00 <NA> <NA>"
    assert annotations.exact_rttm_lines(turn).first().value == want
    assert turn.select(annotations.rttm_line(*(F.col(c) for c in ("file_id", "start", "end", "speaker")))).first()[0] == want
    assert annotations.exact_rttm_lines(turn.withColumn("start", F.lit(0.0625)), 3).first().value.split()[3] == "0.062"
    split = annotations.split_by_file(spark.createDataFrame([("SPEAKER a",), ("SPEAKER b",), ("SPEAKER a",), ("x",)], "value string"))
    assert {r.file_id: r["count"] for r in split.groupBy("file_id").count().collect()} == {"a": 2, "b": 1}


LONG = 'intervals [1]:\n xmin = 0\n xmax = 2.5\n text = "spk1"\nintervals [2]:\n xmin = 2.5\n xmax = 5\n text = ""\nintervals [3]:\n xmin = 5\n xmax = 8\n text = "spk2"\n'
SHORT = '"IntervalTier"\n"name"\n0\n8\n3\n0\n2.5\n"spk1"\n2.5\n5\n""\n5\n8\n"spk2"\n'


def test_textgrid(spark):
    want = [(0.0, 2.5, "spk1"), (5.0, 8.0, "spk2")]
    assert annotations.parse_textgrid(LONG) == annotations.parse_textgrid(SHORT) == want
    files = spark.createDataFrame([("a", LONG), ("b", SHORT), ("c", "")], "file_id string, content string")
    assert annotations.textgrid_intervals(files).where("file_id = 'b'").count() == 2
    for bad in ("2.5.1", "x", "", "1e", "."):
        with pytest.raises(annotations.TextGridError, match="no number"):
            annotations.parse_textgrid(LONG.replace("xmax = 2.5", f"xmax = {bad}"))
        assert annotations.parse_textgrid(SHORT.replace("0\n2.5\n", f"{bad}\n2.5\n", 1)) == want
    with pytest.raises(Exception, match="no number"):
        annotations.textgrid_intervals(files.withColumn("content", F.replace("content", F.lit("xmin = 5"), F.lit("xmin = five")))).collect()
    labels = spark.createDataFrame([("sil",), ("<noise>",), ("SIL",), ("speaker1",)], "label string")
    assert [r.label for r in labels.where(annotations.speech()).collect()] == ["speaker1"]


def test_json_arrays_and_transcripts(spark, tmp_path):
    (tmp_path / "rec.json").write_text('{"segments": [\n {"startTimeSeconds": 1, "endTimeSeconds": 3.5, "speakerId": 7},\n {"startTimeSeconds": 5, "endTimeSeconds": 4, "speakerId": "b"}]}')
    got = annotations.read_json(spark, str(tmp_path / "rec.json")).orderBy("start").collect()
    assert [tuple(r) for r in got] == [("rec", 1.0, 3.5, "7"), ("rec", 5.0, 5.0, "b")]
    lines = spark.createDataFrame([("0\t1.5\thello\tthere",), ("  ",), ("2\t3\t",)], "value string")
    assert [tuple(r) for r in annotations.parse_transcript(lines).collect()] == [(0.0, 1.5, "hello\tthere"), (2.0, 3.0, "")]
    with pytest.raises(Exception):
        annotations.parse_transcript(spark.createDataFrame([("x\t1\ty",)], "value string")).collect()


def test_wav(spark, tmp_path):
    x = np.array([0.0, 0.5, -1.0, 0.25] * 300)
    raw = audio.encode_wav(x)
    samples, rate = audio.decode_wav(raw)
    assert rate == 16000 and np.allclose(samples, x)
    odd = raw[:12] + b"LIST\x03\x00\x00\x00abc\x00" + raw[12:]
    assert len(audio.decode_wav(odd)[0]) == len(x)
    (tmp_path / "a.wav").write_bytes(raw)
    (tmp_path / "b.wav").write_bytes(b"nonsense")
    got = {r.file_id: r for r in audio.read_wav(spark, str(tmp_path)).collect()}
    assert got["a"].duration == len(x) / 16000 and got["a"].error is None and got["b"].samples is None and got["b"].error
    assert len(audio.resample(np.arange(300), 48000)) == 100
    assert vectors.half_to_single(np.array([1.5, -2], "<f2").tobytes()).tolist() == [1.5, -2.0]


def test_features_and_pooling():
    bank = audio.filter_bank(np.random.default_rng(0).standard_normal(160_000) * 0.1)
    assert bank.shape == (998, 80) and np.allclose(bank.mean(axis=0), 0, atol=1e-4)
    assert audio.filter_bank(np.zeros(100)).shape == (0, 80)
    x = np.random.default_rng(1).standard_normal((3, 40))
    pooled = audio.pool_statistics(x, np.ones(20))
    assert np.allclose(pooled[:3], x.mean(axis=1)) and np.allclose(pooled[3:], x.std(axis=1, ddof=1), atol=1e-6)
    assert audio.pool_statistics(x, np.zeros(20)).tolist() == [0, 0, 0, 1e-5, 1e-5, 1e-5]


# ---- powerset, layout, masks, frames


def test_powerset(spark):
    sets = [tuple(i for i, a in enumerate(row) if a) for row in powerset.mapping(3, 2)]
    assert sets == [(), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2)]
    assert [powerset.class_count(*x) for x in ((3, 2), (4, 1), (2, 2), (4, 2))] == [7, 5, 4, 11]
    logits = [(0, [9, 1, 1, 1, 1, 1, 1]), (2, [0, 1, 9, 1, 1, 1, 1]), (4, [0, 1, 1, 1, 9, 1, 8]), (6, [3] * 7)]
    rows = spark.createDataFrame([(c, [float(x) for x in v]) for c, v in logits], "c int, logits array<double>")
    got = powerset.decode(rows, 3, 2)
    assert all(r.c == r.class_idx for r in got.collect())
    masks_ = {r.c: [int(x) for x in r.m] for r in got.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("speaker_idx", "active"))), lambda x: x["active"]).alias("m")).collect()}
    assert masks_[0] == [0, 0, 0] and masks_[2] == [0, 1, 0] and masks_[4] == [1, 1, 0]
    back = powerset.encode(spark.createDataFrame([([1, 1, 0],), ([1, 1, 1],)], "mask array<int>"), 3, 2).collect()
    assert [r.class_idx for r in back] == [4, None]


def test_layout(spark):
    four = spark.range(4).withColumn("f", layout.start_frame(F.col("id").cast("int"), 1.0))
    assert [r.f for r in four.orderBy("id").collect()] == [0, 59, 119, 178]
    assert spark.range(1).select(layout.output_extent(F.lit(4), 1.0), layout.output_extent(F.lit(0), 1.0)).first()[:] == (771, 0)

    def brute(n, win, step):
        out = []
        while len(out) * step + win <= n:
            out.append(len(out) * step)
        if len(out) * step < n and n > win:
            out.append(len(out) * step)
        return out

    for win, step in ((10, 3), (5, 5), (4, 7)):
        files = spark.range(40).withColumn("n_samples", F.col("id").cast("int"))
        got = {}
        for r in layout.windows(files, win, step).collect():
            got.setdefault(r.n_samples, []).append((r.start_sample, r.is_padded))
        for n in range(40):
            assert sorted(got.get(n, [])) == [(s, s + win > n) for s in brute(n, win, step)]
    assert window_step("coreml") == 0.96 and PipelineConfig.for_mode("cuda-fast").vbx.max_iters == 3
    with pytest.raises(ValueError):
        window_step("abacus")


def seg_rows(spark, chunks):
    rows = [(0, c, f, s, float(a)) for c, frames_ in enumerate(chunks) for f, sp in enumerate(frames_) for s, a in enumerate(sp)]
    return spark.createDataFrame(rows, "file_id int, chunk_idx int, frame_idx int, speaker_idx int, active double")


def test_counts_and_top_k(spark):
    step = 0.016875  # a chunk starts one frame after the one before
    seg = seg_rows(spark, [[[1, 0]] * 3, [[0, 1]] * 3])
    assert [r.n_speakers for r in frames.speaker_count(seg, step).where("out_frame < 4").orderBy("out_frame").collect()] == [1, 1, 1, 1]
    assert frames.speaker_count(seg, step).where("out_frame = 500").first().n_speakers == 0
    act = spark.createDataFrame([(0, f, c, s) for f, row in enumerate([[2.0, 2.0, 1.0], [0.0, 5.0, 5.0], [1.0, 0.0, 3.0]]) for c, s in enumerate(row)], "file_id int, out_frame int, cluster int, score double")
    counts = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, 5)], "file_id int, out_frame int, n_speakers int")
    got = {(r.out_frame, r.cluster): r.active for r in frames.top_k(act, counts).collect()}
    assert [got[0, c] for c in range(3)] == [1, 0, 0] and [got[1, c] for c in range(3)] == [0, 1, 0] and [got[2, c] for c in range(3)] == [1, 1, 1]
    only = {(r.out_frame, r.cluster): r.score for r in frames.make_exclusive(act).collect()}
    assert [only[0, c] for c in range(3)] == [0, 2.0, 0] and [only[1, c] for c in range(3)] == [0, 0, 5.0]


def test_smoothing(spark):
    assert smoothing.pick([1.0, 1.05], 1, {0}, 0.1) == [0] and smoothing.pick([1.0, 1.5], 1, {0}, 0.1) == [1] and smoothing.pick([1.0], 3, set(), 0.1) == [0]
    rnd = random.Random(5)
    rows = [(f, t, c, rnd.random()) for f in range(3) for t in range(50) for c in range(4)]
    counts = [(f, t, rnd.randint(0, 5)) for f in range(3) for t in range(50)]
    act = spark.createDataFrame(rows, "file_id int, out_frame int, cluster int, score double").repartition(7)
    got = {(r.file_id, r.out_frame, r.cluster): r.active for r in smoothing.smoothed_top_k(act, spark.createDataFrame(counts, "file_id int, out_frame int, n_speakers int")).collect()}
    by, k = {(f, t): [] for f, t, _ in counts}, {(f, t): n for f, t, n in counts}
    for f, t, _, s in rows:
        by[f, t].append(s)
    for f in range(3):
        before = set()
        for t in range(50):
            before = set(smoothing.pick(by[f, t], k[f, t], before, 0.1))
            assert [got[f, t, c] for c in range(4)] == [int(c in before) for c in range(4)]
    for f, t in k:
        assert sum(got[f, t, c] for c in range(4)) == min(4, k[f, t])


@pytest.mark.parametrize("slice_frames", [1, 7, 64])
def test_smoothing_is_the_same_however_it_is_cut(spark, slice_frames):
    """Stretches of ties longer than a slice, frames without speakers, and a recording without any settled frame."""
    rnd = random.Random(slice_frames)
    by, k = {}, {}
    for f in range(3):
        near = 0
        for t in range(120):
            near = near - 1 if near else rnd.choice([0, 0, 0, 20])
            base = rnd.random()
            by[f, t] = [base + (rnd.random() * 0.15 if near or f == 2 else rnd.random()) for _ in range(4)]
            k[f, t] = 2 if f == 2 else rnd.choice([0, 1, 1, 2, 2, 3, 4, 5])
    for t in range(120):  # recording 2: all within epsilon
        by[2, t] = [0.5 + rnd.random() * 0.05 for _ in range(4)]
    act = spark.createDataFrame([(f, t, c, s) for (f, t), row in by.items() for c, s in enumerate(row)], "file_id int, out_frame int, cluster int, score double").repartition(5)
    counts = spark.createDataFrame([(f, t, n) for (f, t), n in k.items()], "file_id int, out_frame int, n_speakers int")
    got = {(r.file_id, r.out_frame, r.cluster): r.active for r in smoothing.smoothed_top_k(act, counts, slice_frames=slice_frames).collect()}
    for f in range(3):
        before = set()
        for t in range(120):
            before = set(smoothing.pick(by[f, t], k[f, t], before, 0.1))
            assert [got[f, t, c] for c in range(4)] == [int(c in before) for c in range(4)]
    units = smoothing.with_units(smoothing.settle(spark.createDataFrame([(f, t, s, k[f, t]) for (f, t), s in by.items()], "file_id int, out_frame int, scores array<double>, n_speakers int"), 0.1), slice_frames)
    found = units.groupBy("file_id").agg({"unit": "max"}).collect()
    assert {r[0]: r[1] >= 0 for r in found} == {0: True, 1: True, 2: False}


@pytest.mark.parametrize("onset, offset", [(0.4, 0.6), (0.6, 0.4), (0.5, 0.5)])
def test_hysteresis_equals_the_state_machine(spark, onset, offset):
    rnd = random.Random(9)
    tracks = [[rnd.choice([0.1, 0.4, 0.5, 0.55, 0.6, 0.9, float("nan")]) for _ in range(60)] for _ in range(5)]
    df = binarize.hysteresis(scores(spark, *tracks), onset, offset)
    assert on(df) == [s for t in tracks for s in brute_binarize(t, BinarizeConfig(onset, offset))]
    assert "Pandas" not in df._jdf.queryExecution().executedPlan().toString()


def test_mask_choice(spark):
    mask, clean = [[1, 0], [1, 0], [1, 1], [0, 0]], [[1, 0], [1, 1], [1, 1], [0, 0]]
    weight = lambda rows: masks.speaker_weights(seg_rows(spark, [rows]), 16_000, 6_000, 1.0).where("speaker_idx = 0").first()
    a, b = weight([[1, 0], [1, 0], [1, 0], [0, 0]]), weight(clean)
    assert a.use_clean and a.weight == 3 and not b.use_clean and b.weight == 3
    assert weight(mask).weight == 3
    marked = masks.mark_inactive(seg_rows(spark, [[[1, 0]]]), spark.createDataFrame([(0, 0, 0, 4), (0, 0, 1, 4)], "file_id int, chunk_idx int, speaker_idx int, cluster int"))
    assert {r.speaker_idx: r.cluster for r in marked.collect()} == {0: 4, 1: -2}


# ---- errors and intervals


def der(spark, ref, hyp):
    rows = [(0, side, who, a * 1000, b * 1000) for side, x in (("ref", ref), ("hyp", hyp)) for who, a, b in x]
    return errors.components(spark.createDataFrame(rows, SEG)).withColumn("der", errors.rate()).first()


def test_error_vectors(spark):
    assert der(spark, [("A", 0, 5), ("B", 5, 10)], [("X", 0, 5), ("Y", 5, 10)]).der == 0
    r = der(spark, [("A", 0, 10)], [])
    assert r.missed == 10_000 and r.der == 1
    r = der(spark, [("A", 0, 5)], [("X", 0, 5), ("Y", 5, 10)])
    assert r.false_alarm == 5_000 and r.der == 1
    r = der(spark, [("A", 0, 10)], [("X", 0, 5), ("Y", 5, 10)])
    assert r.confusion == 5_000 and r.missed == 0
    r = der(spark, [("A", 0, 10), ("B", 5, 10)], [("A", 0, 10), ("B", 5, 10)])
    assert r.der == 0 and r.total == 15_000
    r = der(spark, [], [("X", 0, 5)])
    assert (r.false_alarm, r.total, r.der) == (5_000, 0, 0)
    r = der(spark, [("A", 0, 4), ("A", 2, 6)], [("X", 0, 6)])
    assert r.total == 6_000 and r.der == 0


def test_error_is_unchanged_by_names_time_and_partitions(spark):
    rnd = random.Random(3)
    rows = [(f, rnd.choice(["ref", "hyp"]), f"s{rnd.randint(0, 3)}", s := rnd.randint(0, 200_000), s + rnd.randint(1, 30_000)) for f in range(6) for _ in range(40)]
    base = sorted(map(tuple, errors.components(spark.createDataFrame(rows, SEG)).collect()))
    other = [(f, side, who[::-1] + "x" if side == "hyp" else who, s + 123_457, e + 123_457) for f, side, who, s, e in rows]
    rnd.shuffle(other)
    assert sorted(map(tuple, errors.components(spark.createDataFrame(other, SEG).repartition(9)).collect())) == base


def test_hungarian_matches_all_orders():
    rng = np.random.default_rng(4)
    for _ in range(200):
        r, c = rng.integers(1, 6, 2).tolist()
        m = rng.integers(-20, 20, (r, c))
        got = errors.hungarian(m)
        assert len(got) == min(r, c) == len({i for i, _ in got}) == len({j for _, j in got})
        small, large = (r, c) if r <= c else (c, r)
        best = min(sum((m[i, p[i]] if r <= c else m[p[i], i]) for i in range(small)) for p in itertools.permutations(range(large), small))
        assert sum(m[i, j] for i, j in got) == best


def test_dominant_speaker(spark):
    rows = spark.createDataFrame([(0, 0, 0, 1000), (0, 1, 5000, 6000), (0, 2, 0, 200_000)], "file_id int, row_idx int, s_ms long, e_ms long")
    segs = spark.createDataFrame([(0, 0, "A", 0, 500), (0, 1, "B", 500, 1000), (0, 2, "C", 90_000, 190_000)], "file_id int, seg_idx int, speaker string, s_ms long, e_ms long")
    got = {r.row_idx: r.speaker for r in intervals.dominant_speaker(rows, segs).collect()}
    assert got == {0: "A", 1: "UNKNOWN", 2: "C"}


def test_budget(spark):
    files = spark.createDataFrame([(0, "long", 180.0), (1, "short", 30.0), (2, "medium", 60.0)], "idx int, name string, duration double")
    pick = lambda n, s: sorted(r.name for r in selection.budgeted(files, n, s).collect())
    assert pick(2, 120.0) == ["medium", "short"] and pick(9, 1.0) == ["short"] and pick(9, 89.0) == ["short"] and pick(9, 1e9) == ["long", "medium", "short"]
    a = spark.createDataFrame([("/x/wav/a.wav",), ("/x/wav/b.wav",)], "path string")
    b = spark.createDataFrame([("/y/rttm/b.rttm",), ("/y/rttm/c.rttm",)], "path string")
    assert [r.stem for r in selection.paired(a, b).collect()] == ["b"] and [r.stem for r in selection.missing(a, b).collect()] == ["c"]


# ---- vectors and kernels


def test_vector_functions(spark):
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 0.0], [-3.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(vectors.cosine("a", "b")).collect()] == [1, 0, -1, 0]
    assert v.select(vectors.l2_normalize("a")).collect()[3][0] == [0.0, 0.0]
    ties = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (2.5000005,), (2.6,)], "x double")
    assert [r[0] for r in ties.select(vectors.round_ties_even(F.col("x"))).collect()] == [0, 2, 2, 2, 3]
    inf = spark.createDataFrame([([0.0, 0.0],), ([float("-inf")],)], "a array<double>")
    assert [r[0] for r in inf.select(vectors.logsumexp("a")).collect()] == [math.log(2), float("-inf")]


def test_linkage_vectors():
    x = np.array([[1, 0], [0.9, 0.3], [0, 1], [0.05, 1]], "float32")
    assert kernels.cluster_rows(x, 0.6).tolist() == [1, 1, 0, 0]
    assert kernels.flat_labels(4, [(2, 3, 0.1), (0, 1, 1.0), (4, 5, 10.45)], 1.0).tolist() == [1, 1, 0, 0]
    assert kernels.cluster_rows(x[:0]).tolist() == [] and kernels.cluster_rows(x[:1]).tolist() == [0]


def test_linkage_matches_true_centroids():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((14, 5))
    groups, n = {i: [i] for i in range(14)}, 14
    for a, b, height in kernels.centroid_linkage(kernels.pairwise_distance(x)):
        best = min((np.linalg.norm(x[p].mean(axis=0) - x[q].mean(axis=0)), i, j) for (i, p), (j, q) in itertools.combinations(groups.items(), 2))
        assert math.isclose(height, best[0], rel_tol=1e-9) and {a, b} == {best[1], best[2]}
        groups[n] = groups.pop(a) + groups.pop(b)
        n += 1


def test_plda():
    p = kernels.Plda.synthetic(12, 6, 3)
    rng = np.random.default_rng(3)
    rng.standard_normal((6, 6))
    x = rng.standard_normal((5, 12)).astype("float32")
    f = p.features(x)
    assert f.shape == (5, 6) and np.allclose(p.features(x[2:3]), f[2:3]) and (np.diff(p.phi) <= 0).all()
    assert np.allclose((p.xvectors(x) ** 2).sum(axis=1), 6)
    tr, psi = np.eye(4) + 0.1 * rng.standard_normal((4, 4)), np.array([1.0, 2, 3, 4])
    q = kernels.Plda.derive(np.zeros(5), np.zeros(4), np.ones((5, 4)), np.zeros(4), tr, psi)
    within, between = np.linalg.inv(tr.T @ tr), np.linalg.inv((tr.T / psi) @ tr)
    for v, lam in zip(q.transform, q.phi):
        assert np.allclose(between @ v, lam * within @ v)
    with pytest.raises(kernels.PldaError):
        kernels.Plda.derive(np.zeros(5), np.zeros(4), np.ones((5, 4)), np.zeros(4), tr, np.array([1.0, 0, 1, 1]))


def test_vbx():
    x = np.array([[10, 10], [9, 11], [10.5, 9.5], [-10, -10], [-9, -11], [-10.5, -9.5]], "float32")
    trace = []
    gamma, prior = kernels.vbx(x, np.ones(2), kernels.initial_responsibilities(np.array([0, 0, 0, 1, 1, 1])), VbxConfig(), trace)
    who = gamma.argmax(axis=1)
    assert len(set(who[:3])) == len(set(who[3:])) == 1 and who[0] != who[3] and np.isclose(prior.sum(), 1)
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:]))
    assert kernels.initial_responsibilities(np.array([0, 1]), -1).tolist() == [[1, 0], [0, 1]]
    assert np.allclose(kernels.initial_responsibilities(np.array([0, 1]), 7)[0], [math.e**7 / (math.e**7 + 1), 1 / (math.e**7 + 1)])


def test_assignment():
    s = np.array([[0.9, 0.1], [0.8, 0.2], [0.1, 0.95]], "float32")
    got = kernels.assign_chunk(s, [0, 1, 2])
    assert len(got) == 2 and got[2] == 1
    assert kernels.assign_chunk(np.full((3, 2), -np.inf, "float32"), [0, 1]) == {}
    assert kernels.assign_chunk(np.ones((3, 2), "float32"), [0, 1, 2]) == {1: 0, 2: 1}
    assert kernels.kept_speakers(np.array([0.5, 1e-9, 0.5], "float32")).tolist() == [0, 2]
    assert kernels.kept_speakers(np.array([0.0, 0.0], "float32")).tolist() == [1]
    one = kernels.cluster_recording(np.zeros((1, 4)), np.zeros((2, 2, 4)), np.array([[True, False], [True, True]]), kernels.Plda.synthetic(4, 2), 0.6, VbxConfig(), 1e-7)
    assert one.tolist() == [[0, -2], [0, 0]]


# ---- pipeline and stream


def test_pipeline_on_synthetic_audio(spark):
    rng = np.random.default_rng(0)
    rows = [(f, (rng.standard_normal(3000) * np.repeat(rng.uniform(0, 1, 30), 100)).astype("float32").tolist()) for f in range(2)] + [(2, [0.0] * 10)]
    df = spark.createDataFrame(rows, "file_id int, samples array<float>")
    p = pipeline.Pipeline(backend.StubBackend, kernels.Plda.synthetic(16, 8), PipelineConfig(step=0.064), window=2048, frames_per_window=20)
    result = p.run(df)
    got = result.segments.collect()
    assert got and {r.file_id for r in got} <= {0, 1} and all(r.end >= r.start for r in got)
    assert result.rttm().first().value.startswith("SPEAKER ")
    single = {tuple(r) for r in p.run(df.where("file_id = 1")).segments.collect()}
    assert single == {tuple(r) for r in got if r.file_id == 1}


def test_stream_takes_what_is_there(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/*")
    done = queue.drain(spark, stream, lambda df: df.withColumn("twice", F.col("id") * 2))
    assert done.count() == 30 and done.agg(F.sum("twice")).first()[0] == 870


def test_failures_stay_with_their_job(spark):
    def work(group):
        if (group["x"] < 0).any():
            raise ValueError("negative")
        return group[["x"]].sum().to_frame().T

    rows = spark.createDataFrame([(1, 1), (1, 2), (2, -1), (3, 5)], "job int, x long")
    got = {r.job: (r.x, r.error) for r in queue.isolated(rows, "job", work, "x long").collect()}
    assert got == {1: (3, None), 2: (None, "ValueError: negative"), 3: (5, None)}


def test_assignment_equals_search_of_all_choices():
    from itertools import combinations, permutations

    rnd = np.random.default_rng(3)
    for _ in range(300):
        n, clusters = int(rnd.integers(1, 4)), int(rnd.integers(1, 6))
        scores = rnd.choice([0, 0.1, 0.25, 0.5, 1, 2], size=(n, clusters)).astype("float32")
        active = sorted(rnd.choice(n, size=int(rnd.integers(1, n + 1)), replace=False).tolist())
        size = min(len(active), clusters)
        every = [dict(zip(chosen, picks)) for chosen in combinations(active, size) for picks in permutations(range(clusters), size)]
        rank = lambda pairs: (-sum((scores[s, c] for s, c in pairs.items()), np.float32(0)), [pairs.get(s, -1) for s in active])
        assert kernels.assign_chunk(scores, active) == min(every, key=rank)
    assert len(kernels.assign_chunk(rnd.random((3, 2000)).astype("float32"), [0, 1, 2])) == 3

"""Scans in slices and joins by cells give what plain loops give, however recordings are cut."""

import random

import pytest
from pyspark.sql import functions as F

from turnlake.operators import errors, intervals, slices, turns


def brute_union(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def brute_merge(rows, gap):
    out = []
    last = None
    for start, speaker, end in sorted(rows):
        if last and last[0] == speaker and start - last[1] < gap:
            out[-1][2] = (start, end)
        else:
            out.append([speaker, start, (start, end)])
        last = (speaker, end)
    return sorted((speaker, start, top[1]) for speaker, start, top in out)


def rows_of(seed, n=400):
    """Recordings of very different length: one with most rows, long and short intervals, ties, empty intervals, negative times."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        f = rnd.choice([0, 0, 0, 0, 1, 2])
        s = rnd.randrange(-2000, 4000) if f else rnd.choice([rnd.randrange(0, 20_000), rnd.randrange(0, 300) * 7])
        out.append((f, rnd.choice("AB"), s, s + rnd.choice([0, 1, 2, 7, 30, 300, rnd.randrange(9000)])))
    return out + out[:20]


SCHEMA = "file_id int, speaker string, s_ms long, e_ms long"


@pytest.mark.parametrize("size", [2, 9, 64, None])
@pytest.mark.parametrize("seed", [1, 2])
def test_scans_are_the_same_however_they_are_cut(spark, monkeypatch, size, seed):
    if size:
        monkeypatch.setattr(slices, "SLICE_ROWS", size)
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert (slices.width(df, ["file_id"], "s_ms") is None) == (size is None)
    got = intervals.union(df, ["file_id"]).collect()
    assert sorted(map(tuple, got)) == sorted((f, *x) for f in range(3) for x in brute_union([r[2:] for r in rows if r[0] == f]))
    points = {f: sorted({t for r in rows if r[0] == f for t in r[2:]}) for f in range(3)}
    got = intervals.elementary(df, ["file_id"]).collect()
    assert sorted((r.file_id, r.lo, r.hi) for r in got) == sorted((f, a, b) for f, p in points.items() for a, b in zip(p, p[1:]))
    as_turns = df.select("file_id", "speaker", F.col("s_ms").alias("start"), F.col("e_ms").alias("end"))
    for gap in (0, 5, 300):
        got = turns.merge(as_turns, gap).collect()
        want = [(f, *x) for f in range(3) for x in brute_merge([(r[2], r[1], r[3]) for r in rows if r[0] == f], gap)]
        assert sorted((r.file_id, r.speaker, r.start, r.end) for r in got) == sorted(want)


def test_a_long_recording_is_many_tasks(spark, monkeypatch):
    """One recording: no window but that of slices sees it whole, and its rows are spread over the slices."""
    monkeypatch.setattr(slices, "SLICE_ROWS", 500)
    df = spark.range(20_000).select(F.lit(0).alias("file_id"), (F.col("id") * 10).alias("s_ms"), (F.col("id") * 10 + F.when(F.col("id") % 7 == 0, 3).otherwise(12)).alias("e_ms"))
    found = intervals.union(df, ["file_id"])
    assert found.count() == (20_000 + 6) // 7
    by = slices.sliced(df, "s_ms", slices.width(df, ["file_id"], "s_ms")).groupBy(slices.SLICE).count().collect()
    assert len(by) >= 40 and max(r[1] for r in by) <= 501


@pytest.mark.parametrize("kind, scale", [("long", 1), ("double", 0.001)])
def test_points_and_overlaps(spark, kind, scale):
    rnd = random.Random(6)
    num = (lambda x: x) if kind == "long" else (lambda x: x * scale)
    make = lambda n: [(rnd.randrange(3), i, num(s := rnd.randrange(-500, 5000)), num(s + rnd.choice([0, 1, 3, 10, 200, 40_000]))) for i in range(n)]
    a, b = make(150), make(150)
    left = spark.createDataFrame(a, f"g int, i int, s {kind}, e {kind}").repartition(3)
    right = spark.createDataFrame(b, f"g int, j int, bs {kind}, be {kind}").repartition(3)
    got = slices.stab(left.select("g", "i", "s"), right, ["g"], "s", "bs", "be").select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[2] <= x[2] < y[3])
    got = slices.overlaps(left, right, ["g"], "s", "e", "bs", "be").select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and max(x[2], y[2]) < min(x[3], y[3]))
    none = right.limit(0)
    assert slices.overlaps(left, none, ["g"], "s", "e", "bs", "be").count() == 0


def test_cells_cover_an_interval_once_in_few_rows(spark):
    rnd = random.Random(2)
    rows = [(s := rnd.randrange(-1000, 1000), s + rnd.choice([0, 1, 2, 5, 63, 64, 1000])) for _ in range(200)]
    df = spark.createDataFrame(rows, "s long, e long").withColumn("c", slices.dyadic_cells(F.col("s"), F.col("e"), 6))
    for r in df.collect():
        held = [x for level, c in r.c for x in range(c << level, (c + 1) << level)]
        assert sorted(held) == list(range(r.s, r.e))
    # ten hours among turns of a second: some forty rows, not one a minute
    turns_ = spark.createDataFrame([(1000 * i, 1000 * i + 1000) for i in range(200_000)] + [(123_457, 36_123_457)], "s long, e long")
    base, levels = slices.spread(turns_, "s", "e")
    long = turns_.where("e - s > 1000000").select(slices.dyadic_cells(F.floor(F.col("s") / F.lit(base)), F.ceil(F.col("e") / F.lit(base)), levels).alias("c")).first()
    assert len(long.c) <= 40 and levels <= 16


def test_errors_are_the_same_in_slices(spark, monkeypatch):
    rows = [(f, rnd_side, sp, s, e) for (f, sp, s, e), rnd_side in zip(rows_of(5, 200), ["ref", "hyp"] * 200) if e > s]
    df = spark.createDataFrame(rows, "file_id int, side string, speaker string, s_ms long, e_ms long")
    whole = sorted(map(tuple, errors.components(df).collect()))
    monkeypatch.setattr(slices, "SLICE_ROWS", 7)
    assert sorted(map(tuple, errors.components(df).collect())) == whole

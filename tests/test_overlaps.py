import random

import numpy as np

from turnlake.operators import intervals, kernels, slices


def brute(rows, turns):
    out = []
    for s, e in rows:
        out.append(max(((min(e, b) - max(s, a), -i) for i, (a, b) in enumerate(turns)), default=(0, 0)))
    return [(-i, over) if over > 0 else None for over, i in out]


def test_largest_overlap_matches_brute_force():
    draw = random.Random(5)
    for _ in range(300):
        span, longest = draw.choice([8, 40, 1000]), draw.choice([3, 20, 900])
        make = lambda n: [(s, s + draw.randint(1, longest)) for s in (draw.randrange(span) for _ in range(n))]  # noqa: E731, B023
        rows, turns = make(draw.randint(1, 30)), make(draw.randint(1, 70))
        at, over = kernels.largest_overlap(*np.array(rows).T, *np.array(turns).T)
        assert [(a, o) if o > 0 else None for a, o in zip(at.tolist(), over.tolist())] == brute(rows, turns)


def test_dominant_speaker_makes_no_pairs(spark, monkeypatch):
    draw = random.Random(6)
    turns = [(f, i, f"s{i % 7}", s, s + draw.choice([1, 5, 40, 700])) for f in range(2) for i, s in enumerate(draw.randrange(2000) for _ in range(400))]
    rows = [(f, i, s, s + draw.choice([1, 9, 60, 1500])) for f in range(3) for i, s in enumerate(draw.randrange(2500) for _ in range(200))]
    left = spark.createDataFrame(rows, "file_id long, row_idx long, s_ms long, e_ms long")
    right = spark.createDataFrame(turns, "file_id long, seg_idx long, speaker string, s_ms long, e_ms long")
    want = {}
    for f in range(3):
        mine = [t for t in turns if t[0] == f]
        for r, best in zip([r for r in rows if r[0] == f], brute([r[2:] for r in rows if r[0] == f], [t[3:] for t in mine])):
            want[r[:2]] = mine[best[0]][2] if best else "UNKNOWN"

    def pairs(*args):
        raise AssertionError("pairs of rows and turns grow with the square of their density")

    monkeypatch.setattr(slices, "overlaps", pairs)
    for size in (100_000, 20):  # whole recordings, and slices with rows and turns longer than they are
        monkeypatch.setattr(slices, "SLICE_ROWS", size)
        got = intervals.dominant_speaker(left, right).collect()
        assert len(got) == len(rows) and {(r.file_id, r.row_idx): r.speaker for r in got} == want

"""Top speakers of a frame with a bias to those of the frame before.

Scores nearer than epsilon are decided by who was active before, others by score.
That order isn't transitive, so the rule is fixed here: a stable insertion sort from
the lowest cluster on.

A frame is settled if what was before can't matter: it has no place or places for all,
or its last place is won by epsilon or more.  (All winners then precede all others at
every step of the sort.)  Settled frames are chosen by an expression.  They also cut a
recording into units that know nothing of each other, so one recording is scanned by
many tasks: a unit begins at the first settled frame of a slice of time, and a slice
without any goes to the unit before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.session import materialized, shuffled

SLICE_FRAMES = 4096


def pick(scores: list[float], k: int, before: set[int], epsilon: float) -> list[int]:
    """Indices of the ``k`` speakers of a frame."""
    if k >= len(scores):
        return list(range(len(scores)))
    order: list[int] = []
    for new in range(len(scores)):
        at = len(order)
        while at:
            other = order[at - 1]
            if abs(scores[new] - scores[other]) < epsilon:
                first = (new in before) and (other not in before)
            else:
                first = scores[new] > scores[other]
            if not first:
                break
            at -= 1
        order.insert(at, new)
    return order[:k]


def settle(frames: DataFrame, epsilon: float) -> DataFrame:
    """Adds top, the clusters of the ``n_speakers`` highest scores, and settled."""
    k, n = F.col("n_speakers"), F.size("scores")
    ranked = F.array_sort(F.transform("scores", lambda s, i: F.struct((-s).alias("d"), i.alias("i"))))
    rows = frames.withColumn("_r", ranked)
    lead = F.get("_r", k)["d"] - F.get("_r", k - 1)["d"]
    top = F.transform(F.slice("_r", F.lit(1), F.greatest(k, F.lit(0))), lambda x: x["i"])
    return rows.select(*frames.columns, top.alias("top"), ((k <= 0) | (k >= n) | F.coalesce(lead >= epsilon, F.lit(False))).alias("settled"))


def with_units(frames: DataFrame, slice_frames: int) -> DataFrame:
    """Adds unit: the first settled frame of the slice at or before the frame, else that of the last slice that has one, else -1."""
    rows = frames.withColumn("_slice", F.floor(F.col("out_frame") / slice_frames))
    firsts = rows.groupBy("file_id", "_slice").agg(F.min(F.when(F.col("settled"), F.col("out_frame"))).alias("_first"))
    # a row a slice, so a recording's window is short
    earlier = F.last("_first", ignorenulls=True).over(W.partitionBy("file_id").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    starts = firsts.withColumn("_before", F.coalesce(earlier, F.lit(-1)))
    return rows.join(starts, ["file_id", "_slice"]).withColumn("unit", F.when(F.col("out_frame") >= F.col("_first"), F.col("_first")).otherwise(F.col("_before"))).drop("_slice", "_first", "_before")


def smoothed_top_k(activations: DataFrame, counts: DataFrame, epsilon: float = 0.1, slice_frames: int = SLICE_FRAMES) -> DataFrame:
    """(file_id, out_frame, cluster, score) with active 0 or 1; clusters of a frame must be dense from 0."""
    frames = activations.groupBy("file_id", "out_frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "score"))), lambda x: x["score"]).alias("scores"))
    done = smoothed(frames.join(shuffled(counts), ["file_id", "out_frame"]), epsilon, slice_frames, ["scores"])
    return done.select("file_id", "out_frame", F.posexplode(F.arrays_zip("scores", "active")).alias("cluster", "_x")).select("file_id", "out_frame", "cluster", F.col("_x.scores").alias("score"), F.col("_x.active").alias("active"))


def smoothed(frames: DataFrame, epsilon: float = 0.1, slice_frames: int = SLICE_FRAMES, keep: list[str] | None = None) -> DataFrame:
    """(file_id, out_frame, the columns ``keep``, active: 0 or 1 per cluster) of frames with n_speakers and scores.

    Frames that are left out have no speaker.
    """
    keep = keep or []
    frames = materialized(settle(frames, epsilon), "frames")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last, before = None, None, set()
        for batch in batches:
            chosen = []
            for file_id, frame, unit, scores, k, top, settled in zip(*[batch[c] for c in ("file_id", "out_frame", "unit", "scores", "n_speakers", "top", "settled")]):
                if (file_id, unit) != at or frame != last + 1:
                    at, before = (file_id, unit), set()
                before, last = set(top.tolist() if settled else pick(scores.tolist(), int(k), before, epsilon)), frame
                chosen.append([int(i in before) for i in range(len(scores))])
            yield batch[["file_id", "out_frame", *keep]].assign(active=chosen)

    kinds = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in ("file_id", "out_frame", *keep))
    longest = frames.agg(F.max("out_frame")).first()[0] or 0
    units = with_units(frames, slice_frames) if longest >= slice_frames else frames.withColumn("unit", F.lit(-1))
    units = units.repartition("file_id", "unit").sortWithinPartitions("file_id", "unit", "out_frame")
    return units.mapInPandas(scan, f"{kinds}, active array<int>")

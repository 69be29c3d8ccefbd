"""Speaker turns from frame scores, and their merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.config import FRAME_DURATION, FRAME_STEP
from turnlake.operators import slices
from turnlake.operators.layout import frame_time


def label(index) -> F.Column:
    return F.format_string("SPEAKER_%02d", index)


def from_frames(rows: DataFrame, frame_step: float = FRAME_STEP, frame_duration: float = FRAME_DURATION) -> DataFrame:
    """Turns (file_id, speaker, start, end) of (file_id, speaker, frame, score) rows with consecutive frames.

    A score above one half switches on, below it off; one half and NaN hold the state.
    A turn ends at the middle of the first frame that is off; one that is on to the end
    closes at the middle of the last frame.
    """
    order = W.partitionBy("file_id", "speaker").orderBy("frame")
    seen = F.when(F.isnan("score"), F.lit(None)).when(F.col("score") > 0.5, 1).when(F.col("score") < 0.5, 0)
    states = rows.withColumn("_on", F.coalesce(F.last(seen, ignorenulls=True).over(order), F.lit(0)))
    edges = states.withColumn("_edge", F.when(F.col("_on") != F.coalesce(F.lag("_on").over(order), F.lit(0)), 1).otherwise(0))
    last = F.max("frame").over(W.partitionBy("file_id", "speaker"))
    edges = edges.withColumn("_last", last).where("_edge = 1").withColumn("_next", F.coalesce(F.lead("frame").over(order), F.col("_last")))
    times = [frame_time(F.col(c), frame_step, frame_duration) for c in ("frame", "_next")]
    return edges.where("_on = 1").select("file_id", "speaker", times[0].alias("start"), times[1].alias("end"))


def from_active(rows: DataFrame, frame_step: float = FRAME_STEP, frame_duration: float = FRAME_DURATION) -> DataFrame:
    """The turns of ``from_frames`` from the frames that are on alone: (file_id, speaker, frame, last_frame), the last one being that of the recording."""
    order = W.partitionBy("file_id", "speaker").orderBy("frame")
    runs = rows.withColumn("_run", F.col("frame") - F.row_number().over(order)).groupBy("file_id", "speaker", "_run")
    runs = runs.agg(F.min("frame").alias("frame"), F.least(F.max("frame") + 1, F.max("last_frame")).alias("_next"))
    times = [frame_time(F.col(c), frame_step, frame_duration) for c in ("frame", "_next")]
    return runs.select("file_id", "speaker", times[0].alias("start"), times[1].alias("end"))


def merge(turns: DataFrame, max_gap: float = 0.0) -> DataFrame:
    """Merge each turn into the one before it in the file's order by start if both have one speaker and the gap is below ``max_gap``."""
    length = slices.width(turns, ["file_id"], "start")
    rows = turns if length is None else slices.sliced(turns, "start", length)
    by = ["file_id"] if length is None else ["file_id", slices.SLICE]
    order = W.partitionBy(*by).orderBy("start", "speaker", "end")
    # places are given once, as equal rows have no order of their own
    rows = rows.withColumns({"_before": F.lag(F.struct("speaker", "end")).over(order), "_place": F.row_number().over(order)})
    before = F.col("_before")
    if length is not None:
        last = F.max_by(F.struct("speaker", "end"), F.struct("start", "speaker", "end"))
        rows = slices.carried(rows, ["file_id"], {"_row": last}, {"_left": ("_row", "before")})
        before = F.coalesce(before, F.col("_left"))
    same = (before["speaker"] == F.col("speaker")) & (F.col("start") - before["end"] < max_gap)
    rows = rows.withColumn("_new", F.when(same, 0).otherwise(1))
    nth = F.sum("_new").over(W.partitionBy(*by).orderBy("_place"))
    if length is not None:
        rows = slices.carried(rows, ["file_id"], {"_sum": F.sum("_new")}, {"_n": ("_sum", "sum")})
        nth = nth + F.col("_n")
    rows = rows.withColumn("_turn", nth)
    return rows.groupBy("file_id", "_turn").agg(F.first("speaker").alias("speaker"), F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end")).drop("_turn")


def duration() -> F.Column:
    return F.col("end") - F.col("start")

"""Hysteresis and run-length filters over (file_id, speaker, frame, score) rows with consecutive frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.config import BinarizeConfig

GROUP = ["file_id", "speaker"]


def _order():
    return W.partitionBy(*GROUP).orderBy("frame")


def hysteresis(rows: DataFrame, onset: float = 0.5, offset: float = 0.5) -> DataFrame:
    """Adds on: switches on at a score of ``onset`` and off below ``offset``; off at first.

    With onset >= offset the state is that of the last frame beyond a threshold.
    Otherwise a score between the two switches, whatever the state, so the state is the
    last fixed one and the parity of the switches since.  A NaN holds the state.
    """
    score, known = F.col("score"), ~F.isnan("score")
    if onset >= offset:
        seen = F.when(known & (score >= onset), 1).when(known & (score < offset), 0)
        return rows.withColumn("on", F.coalesce(F.last(seen, ignorenulls=True).over(_order()), F.lit(0)))
    switches = F.sum(F.when(known & (score >= onset) & (score < offset), 1).otherwise(0)).over(_order())
    fixed = F.when(known & (score >= offset), 1).when(known & (score < onset), 0)
    rows = rows.withColumn("_n", switches)
    at = F.last(F.when(fixed.isNotNull(), F.struct(fixed.alias("on"), F.col("_n").alias("n"))), ignorenulls=True).over(_order())
    state = (F.coalesce(F.col("_at.on"), F.lit(0)) + F.col("_n") - F.coalesce(F.col("_at.n"), F.lit(0))) % 2
    return rows.withColumn("_at", at).withColumn("on", state.cast("int")).drop("_at", "_n")


def _islands(rows: DataFrame) -> DataFrame:
    change = F.when(F.col("on") != F.lag("on").over(_order()), 1).otherwise(0)
    return rows.withColumn("_change", change).withColumn("_run", F.sum("_change").over(_order())).drop("_change")


def find_runs(rows: DataFrame) -> DataFrame:
    """Maximal runs: file_id, speaker, on, start, end (exclusive)."""
    return _islands(rows).groupBy(*GROUP, "_run").agg(F.first("on").alias("on"), F.min("frame").alias("start"), (F.max("frame") + 1).alias("end")).drop("_run")


def _run_length():
    return F.count(F.lit(1)).over(W.partitionBy(*GROUP, "_run"))


def remove_short_on(rows: DataFrame, min_on: int) -> DataFrame:
    if not min_on:
        return rows
    return _islands(rows).withColumn("on", F.when((F.col("on") == 1) & (_run_length() >= min_on), 1).otherwise(0)).drop("_run")


def fill_short_off(rows: DataFrame, min_off: int) -> DataFrame:
    """Fill runs that are off between two that are on."""
    if not min_off:
        return rows
    whole = W.partitionBy(*GROUP)
    inner = (F.col("_run") > F.min("_run").over(whole)) & (F.col("_run") < F.max("_run").over(whole))
    return _islands(rows).withColumn("on", F.when((F.col("on") == 0) & inner & (_run_length() < min_off), 1).otherwise(F.col("on"))).drop("_run")


def pad(rows: DataFrame, onset: int, offset: int) -> DataFrame:
    """Each run that is on starts ``onset`` frames earlier and ends ``offset`` frames later."""
    if not onset and not offset:
        return rows
    return rows.withColumn("on", F.max("on").over(_order().rowsBetween(-offset, onset)))


def binarize(rows: DataFrame, config: BinarizeConfig | None = None) -> DataFrame:
    """Adds on, by all four steps in order."""
    c = config or BinarizeConfig()
    return pad(fill_short_off(remove_short_on(hysteresis(rows, c.onset, c.offset), c.min_on), c.min_off), c.pad_onset, c.pad_offset)

"""Interval algebra on turns: unions, elementary intervals, who is active, coverage, transcripts.

Range joins carry an equality on the group and on a cell of time, so they hash and
never become nested loops.  Scans cut long groups into slices of time.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.operators import kernels, slices
from turnlake.session import materialized, shuffled


def union(rows: DataFrame, by: list[str], start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    """Union of the intervals of each group; intervals that touch are merged."""
    furthest = rows.groupBy(*by, start).agg(F.max(end).alias(end))
    length = slices.width(furthest, by, start)
    if length is None:
        order = W.partitionBy(*by).orderBy(start)
        reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
        marked = furthest.withColumn("_new", F.when(F.col(start) <= reach, None).otherwise(F.col(start)))
        marked = marked.withColumn("_island", F.last("_new", ignorenulls=True).over(order))
    else:
        order = W.partitionBy(*by, slices.SLICE).orderBy(start)
        parts = slices.carried(slices.sliced(furthest, start, length), by, {"_end": F.max(end)}, {"_reach": ("_end", "max")})
        reach = F.greatest("_reach", F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1)))  # ignores nulls
        parts = parts.withColumn("_new", F.when(F.col(start) <= reach, None).otherwise(F.col(start))).drop("_reach")
        parts = slices.carried(parts, by, {"_last": F.max("_new")}, {"_open": ("_last", "last")})
        marked = parts.withColumn("_island", F.coalesce(F.last("_new", ignorenulls=True).over(order), "_open"))
    return marked.groupBy(*by, "_island").agg(F.max(end).alias(end)).select(*by, F.col("_island").alias(start), end)


def elementary(rows: DataFrame, by: list[str], start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    """Intervals lo, hi between neighbouring distinct boundaries of each group."""
    points = rows.select(*by, F.explode(F.array(start, end)).alias("lo")).distinct()
    length = slices.width(points, by, "lo")
    if length is None:
        return points.withColumn("hi", F.lead("lo").over(W.partitionBy(*by).orderBy("lo"))).where("hi is not null")
    parts = slices.carried(slices.sliced(points, "lo", length), by, {"_first": F.min("lo")}, {"_next": ("_first", "behind")})
    hi = F.coalesce(F.lead("lo").over(W.partitionBy(*by, slices.SLICE).orderBy("lo")), "_next")
    return parts.withColumn("hi", hi).where("hi is not null").select(*by, "lo", "hi")


def active(intervals: DataFrame, rows: DataFrame, by: list[str], start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    """Pairs of an elementary interval and a row of ``rows`` that is active all through it."""
    return slices.stab(intervals, rows, by, "lo", start, end)


def coverage(rows: DataFrame, others: DataFrame, by: list[str], start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    """Per group: total length of the union of ``rows`` and how much of it the union of ``others`` covers, also in percent.

    The percentage is null where either side has nothing or the total is 0.
    """
    sides = [side.select(*by, start, end, F.lit(i).alias("_side")) for i, side in enumerate((rows, others))]
    both = materialized(union(sides[0].unionByName(sides[1]), [*by, "_side"], start, end), "union")  # narrow rows that are read several times
    a, b = (both.where(F.col("_side") == i).drop("_side") for i in range(2))
    pairs = slices.overlaps(a, b.select(*by, F.col(start).alias("_s"), F.col(end).alias("_e")), by, start, end, "_s", "_e")
    shared = pairs.groupBy(*by).agg(F.sum(F.least(end, "_e") - F.greatest(start, "_s")).alias("covered"))
    total = a.groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias("total"))
    there = b.select(*by).distinct().withColumn("_there", F.lit(True))
    out = total.join(shared, by, "left").join(there, by, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return out.withColumn("percent", F.when(F.col("_there") & (F.col("total") > 0), 100 * F.col("covered") / F.col("total"))).drop("_there")


def airtime(rows: DataFrame, by: list[str], start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias("airtime"))


def stats(rows: DataFrame, by: list[str], start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    """Segments, speakers, total speech and last end of each group."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("segments"), F.count_distinct("speaker").alias("speakers"), F.sum(F.col(end) - F.col(start)).alias("speech"), F.max(end).alias("span"))


def first_seen(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Speakers of each group with their index in order of first appearance."""
    first = rows.groupBy(*by, "speaker").agg(F.min(order).alias("_first"))
    return first.withColumn("idx", (F.row_number().over(W.partitionBy(*by).orderBy("_first", "speaker")) - 1).cast("int")).drop("_first")


def dominant_speaker(transcript: DataFrame, turns: DataFrame, start: str = "s_ms", end: str = "e_ms", unknown: str = "UNKNOWN") -> DataFrame:
    """Adds speaker to transcript rows (file_id, row_idx, start, end): that of the one turn with the largest overlap.

    Overlaps aren't added up over turns; of equal ones the first turn (``seg_idx``)
    wins; without an overlap the speaker is ``unknown``.

    No pairs are made.  A row and what may overlap it meet in a part of time that is
    twice as long as a slice, and rows longer than a slice in slices of double lengths.
    A turn is sent to the few parts in which it starts or ends; of those that hold all of
    a part the first is enough.  Within a part the best turn is looked up.
    """
    right = turns.select("file_id", "seg_idx", "speaker", F.col(start).alias("_s"), F.col(end).alias("_e")).where("_e > _s")
    rows = transcript.select("file_id", "row_idx", F.col(start).alias("_s"), F.col(end).alias("_e")).where("_e > _s")
    length = slices.width(right, ["file_id"], "_s")
    if length is None:
        rows, right = (x.withColumns({"_level": F.lit(0), "_part": F.lit(0).cast("long")}) for x in (rows, right))
    else:
        rows, right = _in_parts(rows, right, length)
    key = ["file_id", "_level", "_part"]

    def solve(left: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        other = other.sort_values("seg_idx")
        at, over = kernels.largest_overlap(*(x[c].to_numpy() for x in (left, other) for c in ("_s", "_e")))
        met = over > 0
        found = other.iloc[at[met]]
        return pd.DataFrame({"file_id": left["file_id"].to_numpy()[met], "row_idx": left["row_idx"].to_numpy()[met], "speaker": found["speaker"].to_numpy(), "_seg": found["seg_idx"].to_numpy(), "_over": over[met]})

    kinds = [f"{c} {t.schema[n].dataType.simpleString()}" for c, n, t in (("file_id", "file_id", rows), ("row_idx", "row_idx", rows), ("speaker", "speaker", right), ("_seg", "seg_idx", right), ("_over", "_s", right))]
    pairs = rows.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(solve, ", ".join(kinds))
    best = pairs.groupBy("file_id", "row_idx").agg(F.max_by("speaker", F.struct("_over", -F.col("_seg"))).alias("speaker"))
    return transcript.join(shuffled(best), ["file_id", "row_idx"], "left").withColumn("speaker", F.coalesce("speaker", F.lit(unknown)))


def _in_parts(rows: DataFrame, turns: DataFrame, length: float) -> tuple[DataFrame, DataFrame]:
    """Rows and turns (_s, _e) with the level and part in which they meet; part c of level l is the time from c to c + 2 in slices of ``length`` * 2^l."""
    size = F.lit(length) * F.pow(F.lit(2.0), "_level")
    rows = rows.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2((F.col("_e") - F.col("_s")) / F.lit(length)))).cast("int"))
    rows = rows.withColumn("_part", F.floor(F.col("_s") / size).cast("long"))
    levels = [x[0] for x in rows.select("_level").distinct().collect()]  # some ten, as lengths double
    longest = turns.agg(F.max(F.col("_e") - F.col("_s"))).first()[0] or 0
    turns = turns.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in sorted(levels) or [0]])))
    first, last = (F.floor(F.col(c) / size).cast("long") for c in ("_s", "_e"))
    ends = turns.withColumn("_part", F.explode(F.array_distinct(F.array(first - 1, first, last - 1, last))))
    # parts that a turn holds all of, in cells of parts that double
    most = max(0, math.ceil(math.log2(max(1.0, longest / length))))
    cells = slices.dyadic_cells(F.ceil(F.col("_s") / size).cast("long"), F.floor(F.col("_e") / size).cast("long") - 1, most)
    held = turns.withColumn("_c", F.explode(cells)).groupBy("file_id", "_level", "_c").agg(F.min(F.struct("seg_idx", "speaker", "_s", "_e")).alias("_t"))
    above = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda n: F.struct(n.cast("int").alias("level"), F.floor(F.col("_part") / F.pow(F.lit(2.0), n)).cast("long").alias("cell")))
    parts = rows.select("file_id", "_level", "_part").distinct().withColumn("_c", F.explode(above))
    whole = parts.join(held, ["file_id", "_level", "_c"]).select("file_id", "_level", "_part", "_t.*")
    return rows, ends.unionByName(whole.select(*ends.columns))

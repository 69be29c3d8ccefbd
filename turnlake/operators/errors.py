"""Diarization error: missed speech, false alarm and confusion under the best one-to-one speaker mapping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.operators import intervals
from turnlake.session import materialized


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a least-cost assignment of a rectangular matrix, by shortest augmenting paths."""
    cost = np.asarray(cost, "float64")
    if cost.size == 0:
        return []
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    rows, cols = c.shape
    u, v, owner = np.zeros(rows), np.zeros(cols), np.full(cols, -1)
    for row in range(rows):
        best, via, done = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols, bool)
        at, col, reach = row, -1, 0.0
        while at >= 0:
            slack = np.where(done, np.inf, reach + c[at] - u[at] - v)
            closer = slack < best
            best[closer], via[closer] = slack[closer], col
            nxt = int(np.argmin(np.where(done, np.inf, best)))
            done[nxt], reach, col = True, best[nxt], nxt
            at = owner[nxt]
        u[row] += reach
        seen = done & (owner >= 0)
        u[owner[seen]] += reach - best[seen]
        v[done] -= reach - best[done]
        while col >= 0:
            back = via[col]
            owner[col] = row if back < 0 else owner[back]
            col = back
    pairs = [(int(r), j) for j, r in enumerate(owner) if r >= 0]
    return sorted((j, r) for r, j in pairs) if turned else sorted(pairs)


def cells(segments: DataFrame) -> DataFrame:
    """Elementary intervals in which anyone is active: file_id, dt, refs and hyps (the speakers of each side).

    One range join and one aggregate, from which all figures of a file follow.  A
    speaker that overlaps itself counts once.
    """
    merged = materialized(intervals.union(segments, ["file_id", "side", "speaker"]), "turns")
    on = intervals.active(intervals.elementary(merged, ["file_id"]), merged, ["file_id"])
    side = lambda name: F.collect_list(F.when(F.col("side") == name, F.col("speaker")))
    return on.groupBy("file_id", "lo", "hi").agg(side("ref").alias("refs"), side("hyp").alias("hyps")).withColumn("dt", F.col("hi") - F.col("lo"))


def cooccurrence(segments: DataFrame) -> DataFrame:
    """Per file and pair of a reference and a hypothesis speaker: how long both are active."""
    return _pairs(cells(segments))


def _pairs(rows: DataFrame) -> DataFrame:
    pairs = rows.select("file_id", "dt", "hyps", F.explode("refs").alias("ref_speaker")).select("file_id", "dt", "ref_speaker", F.explode("hyps").alias("hyp_speaker"))
    return pairs.groupBy("file_id", "ref_speaker", "hyp_speaker").agg(F.sum("dt").alias("overlap"))


def best_overlap(pairs: DataFrame) -> DataFrame:
    """Per file the overlap of the best one-to-one mapping; the matrix is speakers by speakers, small for any recording."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        m = group.pivot_table(index="ref_speaker", columns="hyp_speaker", values="overlap", fill_value=0).to_numpy()
        return pd.DataFrame({"file_id": [group["file_id"].iloc[0]], "matched": [int(sum(m[i, j] for i, j in hungarian(-m)))]})

    kind = pairs.schema["file_id"].dataType.simpleString()
    return pairs.groupBy("file_id").applyInPandas(solve, f"file_id {kind}, matched long")


def mapping(pairs: DataFrame) -> DataFrame:
    """The best mapping itself: file_id, ref_speaker, hyp_speaker with a positive overlap."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        table = group.pivot_table(index="ref_speaker", columns="hyp_speaker", values="overlap", fill_value=0)
        m = table.to_numpy()
        found = [(group["file_id"].iloc[0], table.index[i], table.columns[j]) for i, j in hungarian(-m) if m[i, j] > 0]
        return pd.DataFrame(found, columns=["file_id", "ref_speaker", "hyp_speaker"])

    kind = pairs.schema["file_id"].dataType.simpleString()
    return pairs.groupBy("file_id").applyInPandas(solve, f"file_id {kind}, ref_speaker string, hyp_speaker string")


def components(segments: DataFrame) -> DataFrame:
    """Per file: missed, false_alarm, confusion, total of (file_id, side, speaker, s_ms, e_ms) rows.

    A file without reference has its hypothesis durations as false alarm, overlaps of a
    speaker with itself counted twice, and a total of 0.
    """
    rows = materialized(cells(segments), "cells")
    r, h = F.size("refs"), F.size("hyps")
    total = lambda x: F.sum(x * F.col("dt"))
    sums = rows.groupBy("file_id").agg(
        total(r).alias("total"), total(F.greatest(F.lit(0), r - h)).alias("missed"), total(F.greatest(F.lit(0), h - r)).alias("false_alarm"), total(F.least(r, h)).alias("both")
    )
    raw = segments.groupBy("file_id").agg(F.count_if(F.col("side") == "ref").alias("_refs"), F.sum(F.when(F.col("side") == "hyp", F.col("e_ms") - F.col("s_ms"))).alias("_raw"))
    out = raw.join(sums, "file_id", "left").join(best_overlap(_pairs(rows)), "file_id", "left").na.fill(0, ["total", "missed", "false_alarm", "both", "matched", "_raw"])
    alone = F.col("_refs") == 0
    return out.select(
        "file_id", "missed", F.when(alone, F.col("_raw")).otherwise(F.col("false_alarm")).alias("false_alarm"), (F.col("both") - F.col("matched")).alias("confusion"), "total",
    )


def rate() -> F.Column:
    """Error rate of component columns; 0 without reference speech."""
    return F.when(F.col("total") > 0, (F.col("missed") + F.col("false_alarm") + F.col("confusion")) / F.col("total")).otherwise(0.0)


def corpus(files: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """Pooled components and rate over ``files`` (file_id and the columns ``by``).

    A file without any hypothesis row is missed as a whole, as the plain sum of its
    reference durations.
    """
    raw = segments.groupBy("file_id").agg(F.count_if(F.col("side") == "hyp").alias("_hyps"), F.sum(F.when(F.col("side") == "ref", F.col("e_ms") - F.col("s_ms"))).alias("_ref"))
    rows = files.join(components(segments), "file_id", "left").join(raw, "file_id", "left").na.fill(0)
    none = F.col("_hyps") == 0
    rows = rows.withColumns({"missed": F.when(none, F.col("_ref")).otherwise(F.col("missed")), "total": F.when(none, F.col("_ref")).otherwise(F.col("total"))})
    sums = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("missed", "false_alarm", "confusion", "total")])
    return sums.withColumn("der", rate())

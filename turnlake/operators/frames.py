"""Overlap-added frames: speaker counts, cluster activations, top speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.functions.vectors import round_ties_even
from turnlake.operators.layout import output_extent, start_frame, to_output_frames
from turnlake.session import materialized, shuffled


def _chunks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file_id").agg((F.max("chunk_idx") + 1).alias("_n"))


def grid(rows: DataFrame, step: float) -> DataFrame:
    """Every output frame of every file in ``rows``."""
    return _chunks(rows).select("file_id", F.explode(F.sequence(F.lit(0), output_extent(F.col("_n"), step) - 1)).alias("out_frame"))


def speaker_count(seg: DataFrame, step: float) -> DataFrame:
    """Per output frame the mean number of speakers over the chunks that cover it, rounded; 0 where none does."""
    sums = to_output_frames(seg, step).groupBy("file_id", "out_frame", "chunk_idx").agg(F.sum("active").alias("n"))
    mean = sums.groupBy("file_id", "out_frame").agg(F.avg("n").alias("mean"))
    return grid(seg, step).join(shuffled(mean), ["file_id", "out_frame"], "left").select("file_id", "out_frame", F.greatest(F.lit(0), round_ties_even(F.coalesce("mean", F.lit(0.0)))).alias("n_speakers"))


def all_zero(counts: DataFrame) -> DataFrame:
    """Per file: whether no frame has a speaker, and the most speakers at once."""
    return counts.groupBy("file_id").agg((F.max("n_speakers") == 0).alias("silent"), F.max("n_speakers").alias("most"))


def cluster_activations(seg: DataFrame, clusters: DataFrame, step: float, counts: DataFrame | None = None) -> DataFrame:
    """Per output frame and cluster: the sum over chunks of the largest activity among the cluster's local speakers.

    Dense over clusters 0 to the highest id, and up to the most simultaneous speakers if ``counts`` are given.
    """
    named = seg.join(shuffled(clusters.where("cluster >= 0")), ["file_id", "chunk_idx", "speaker_idx"])
    most = named.groupBy("file_id", "chunk_idx", "frame_idx", "cluster").agg(F.max("active").alias("active"))
    placed = most.join(_chunks(seg), "file_id")
    placed = placed.withColumn("out_frame", start_frame(F.col("chunk_idx"), step) + F.col("frame_idx")).where(F.col("out_frame") < output_extent(F.col("_n"), step))
    sums = placed.groupBy("file_id", "out_frame", "cluster").agg(F.sum("active").alias("score"))
    width = clusters.groupBy("file_id").agg((F.max("cluster") + 1).alias("_w"))
    if counts is not None:
        width = width.join(counts.groupBy("file_id").agg(F.max("n_speakers").alias("_m")), "file_id", "left").withColumn("_w", F.greatest("_w", F.coalesce("_m", F.lit(0)))).drop("_m")
    # a row a file until all joins of files are done
    dense = _chunks(seg).join(width.where("_w > 0"), "file_id").select("file_id", "_w", F.explode(F.sequence(F.lit(0), output_extent(F.col("_n"), step) - 1)).alias("out_frame"))
    dense = dense.select("file_id", "out_frame", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("cluster"))
    return dense.join(shuffled(sums), ["file_id", "out_frame", "cluster"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def spoken(windows: DataFrame, clusters: DataFrame, step: float, speakers: int) -> DataFrame:
    """Frames with a speaker only: n_speakers as in ``speaker_count``, scores as in ``cluster_activations``, last_frame of the recording.

    ``windows`` are rows (file_id, chunk_idx, on: bits of the active speakers of a frame),
    ``clusters`` rows (file_id, chunk_idx, chunks of the recording, width: its clusters, labels of the speakers).
    """
    rows = windows.select("file_id", "chunk_idx", "on").join(shuffled(clusters), ["file_id", "chunk_idx"])
    rows = rows.select("file_id", "chunk_idx", "chunks", "width", "labels", F.posexplode("on").alias("frame_idx", "_bits"))
    extent = output_extent(F.col("chunks"), step)
    rows = rows.withColumn("out_frame", start_frame(F.col("chunk_idx"), step) + F.col("frame_idx")).where(F.col("out_frame") < extent)
    here = F.array_distinct(F.filter("labels", lambda c, s: (c >= 0) & (F.getbit("_bits", s) == 1)))
    found = rows.groupBy("file_id", "out_frame").agg(
        F.avg(F.bit_count("_bits")).alias("_mean"), F.flatten(F.collect_list(here)).alias("_on"), F.max("width").alias("width"), (F.max(extent) - 1).alias("last_frame")
    )
    found = materialized(found.withColumn("n_speakers", round_ties_even(F.col("_mean"))).where("n_speakers > 0").drop("_mean"), "spoken")
    most = found.groupBy("file_id").agg(F.max("n_speakers").alias("_m"))
    found = found.join(shuffled(most), "file_id")
    scores = F.transform(F.sequence(F.lit(0), F.greatest("width", "_m") - 1), lambda c: F.size(F.filter("_on", lambda x: x == c)).cast("double"))
    return found.select("file_id", "out_frame", "n_speakers", scores.alias("scores"), "last_frame")


def top_k(activations: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds active: 1 for the ``n_speakers`` highest scores of a frame, the lowest cluster on ties."""
    rank = F.row_number().over(W.partitionBy("file_id", "out_frame").orderBy(F.desc("score"), "cluster"))
    return activations.join(shuffled(counts), ["file_id", "out_frame"]).withColumn("active", (rank <= F.col("n_speakers")).cast("int")).drop("n_speakers")


def make_exclusive(rows: DataFrame, frame: str = "out_frame", speaker: str = "cluster", score: str = "score") -> DataFrame:
    """Zero all but a frame's highest score, the last speaker of equal ones; frames whose highest is 0 stay."""
    w = W.partitionBy("file_id", frame)
    first = F.row_number().over(w.orderBy(F.desc(score), F.desc(speaker))) == 1
    return rows.withColumn(score, F.when(first | (F.max(score).over(w) == 0), F.col(score)).otherwise(F.lit(0).cast(rows.schema[score].dataType)))

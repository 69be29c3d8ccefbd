"""Speaker masks of chunks: clean frames, choice of a mask, training rows, inactive speakers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.config import INACTIVE, MIN_SPEAKER_ACTIVITY
from turnlake.functions.vectors import all_finite
from turnlake.session import shuffled

KEY = ["file_id", "chunk_idx", "speaker_idx"]


def clean_masks(seg: DataFrame) -> DataFrame:
    """Adds clean: active in frames with fewer than two speakers, else 0."""
    speakers = F.sum("active").over(W.partitionBy("file_id", "chunk_idx", "frame_idx"))
    return seg.withColumn("clean", F.when(speakers < 2, F.col("active")).otherwise(0.0))


def speaker_weights(seg: DataFrame, num_samples: int, min_num_samples: int = 400, min_activity: float = MIN_SPEAKER_ACTIVITY) -> DataFrame:
    """Per chunk and speaker with enough activity: whether the clean mask serves, and the frames of the chosen mask.

    The clean mask serves if its frames outnumber the frames that the model's least
    number of samples takes, rounded up.
    """
    sums = clean_masks(seg).groupBy(*KEY).agg(F.sum("active").alias("activity"), F.sum("clean").alias("clean_activity"), F.count(F.lit(1)).alias("mask_len"))
    needed = F.ceil(F.col("mask_len") * F.lit(min_num_samples) / F.lit(num_samples)) if num_samples > 0 else F.lit(None)
    use = F.coalesce(F.col("clean_activity") > needed, F.lit(False))
    return sums.where(F.col("activity") >= min_activity).select(*KEY, use.alias("use_clean"), F.when(use, F.col("clean_activity")).otherwise(F.col("activity")).alias("weight"))


def chosen_masks(active: np.ndarray, num_samples: int, min_num_samples: int = 400, min_activity: float = MIN_SPEAKER_ACTIVITY) -> tuple[np.ndarray, np.ndarray]:
    """``clean_masks`` and ``speaker_weights`` of windows (windows, speakers, frames) of 0 and 1: the chosen masks, and the frames in which each speaker is alone."""
    speakers = active.sum(axis=1, keepdims=True)
    clean = np.where(speakers < 2, active, 0.0)
    needed = math.ceil(active.shape[2] * min_num_samples / num_samples) if num_samples > 0 else math.inf
    use = (clean.sum(axis=2) > needed) & (active.sum(axis=2) >= min_activity)
    return np.where(use[:, :, None], clean, active), np.where(speakers == 1, active, 0.0).sum(axis=2)


def trains(single: np.ndarray, frames: int, share: float = 0.2) -> np.ndarray:
    """The rule of ``training_set`` on the frames in which a speaker is alone."""
    return single >= share * frames


def training_set(seg: DataFrame, embeddings: DataFrame, share: float = 0.2) -> DataFrame:
    """Embeddings that are finite and whose speaker is alone in ``share`` of the chunk's frames."""
    alone = F.abs(F.sum("active").over(W.partitionBy("file_id", "chunk_idx", "frame_idx")) - 1) < 1e-6
    frames = seg.groupBy("file_id", "chunk_idx").agg(F.count_distinct("frame_idx").alias("_frames"))
    single = seg.withColumn("_alone", F.when(alone, F.col("active")).otherwise(0.0)).groupBy(*KEY).agg(F.sum("_alone").alias("single_activity"))
    kept = single.join(shuffled(frames), ["file_id", "chunk_idx"]).where(F.col("single_activity") >= share * F.col("_frames")).drop("_frames")
    return embeddings.where(all_finite("embedding")).join(shuffled(kept), KEY)


def mark_inactive(seg: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters of chunk speakers, ``INACTIVE`` where the speaker has no active frame."""
    sums = seg.groupBy(*KEY).agg(F.sum("active").alias("_sum"))
    return clusters.join(shuffled(sums), KEY, "left").withColumn("cluster", F.when(F.coalesce("_sum", F.lit(0.0)) <= 0, INACTIVE).otherwise(F.col("cluster"))).drop("_sum")

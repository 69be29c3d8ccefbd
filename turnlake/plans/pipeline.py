"""From windows to turns: inference artifacts, clustering of recordings, reconstruction, turns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnlake.config import FRAMES_PER_WINDOW, LOCAL_SPEAKERS, MAX_OVERLAP, SAMPLE_RATE, WINDOW_SECONDS, PipelineConfig
from turnlake.operators import binarize, frames, kernels, layout, masks, smoothing, turns
from turnlake.plans import backend as seam
from turnlake.session import materialized, shuffled
from turnlake.sources import wav_ranges
from turnlake.sources.annotations import exact_rttm_lines
from turnlake.streaming import queue


@dataclass
class Artifacts:
    """Decoded segmentations (file_id, chunk_idx, frame_idx, speaker_idx, active) and embeddings (file_id, chunk_idx, speaker_idx, embedding)."""

    segmentations: DataFrame
    embeddings: DataFrame
    #: the same as a row per window, if models have made them (``backend.WINDOW_COLUMNS``)
    windows: DataFrame | None = None

    @classmethod
    def of_windows(cls, windows: DataFrame) -> Artifacts:
        """Rows of frames and of speakers are only made of stored windows if something reads them."""
        bits = F.array(*[F.getbit("_bits", F.lit(s)).cast("double") for s in range(LOCAL_SPEAKERS)])
        seg = windows.select("file_id", "chunk_idx", F.posexplode("on").alias("frame_idx", "_bits")).select("file_id", "chunk_idx", "frame_idx", F.posexplode(bits).alias("speaker_idx", "active"))
        dim = (F.size("embeddings") / LOCAL_SPEAKERS).cast("int")
        each = F.transform("asked", lambda there, s: F.when(there, F.slice("embeddings", s * dim + 1, dim)))
        return cls(seg, windows.select("file_id", "chunk_idx", F.posexplode(each).alias("speaker_idx", "embedding")), windows)

    def stored(self) -> Artifacts:
        """The same, written once below the shared folder: models run once, whatever reads their results."""
        return Artifacts(materialized(self.segmentations, "segmentations"), materialized(self.embeddings, "embeddings"))


@dataclass
class Result:
    artifacts: Artifacts
    counts: DataFrame
    clusters: DataFrame
    activations: DataFrame
    discrete: DataFrame
    segments: DataFrame

    def rttm(self) -> DataFrame:
        return exact_rttm_lines(self.segments)

    def exclusive(self) -> DataFrame:
        """The discrete diarization with one speaker a frame at most."""
        return frames.make_exclusive(self.discrete, score="active")


def cluster_recordings(artifacts: Artifacts, plda: kernels.Plda, config: PipelineConfig) -> DataFrame:
    """Clusters of every (file_id, chunk_idx, speaker_idx): one kernel per recording, which must fit a worker."""
    seg, on = artifacts.segmentations, masks.KEY
    active = seg.groupBy(*on).agg((F.sum("active") > 0).alias("_active"))
    chosen = masks.training_set(seg, artifacts.embeddings).select(*on, F.lit(True).alias("_training"))
    rows = active.join(shuffled(artifacts.embeddings), on, "left").join(shuffled(chosen), on, "left")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["chunk_idx", "speaker_idx"])
        chunks, at = np.unique(group["chunk_idx"].to_numpy(), return_inverse=True)
        speaker = group["speaker_idx"].to_numpy()
        dim = max((len(e) for e in group["embedding"] if e is not None), default=1)
        flat = np.array([np.full(dim, np.nan) if e is None else np.asarray(e, "float64") for e in group["embedding"]], "float64")
        embeddings = np.full((len(chunks), speaker.max() + 1, dim), np.nan)
        embeddings[at, speaker] = flat
        on = np.zeros(embeddings.shape[:2], bool)
        on[at, speaker] = group["_active"].to_numpy(bool)
        training = flat[group["_training"].notna().to_numpy()].astype("float32")
        labels = kernels.cluster_recording(training, embeddings, on, plda, config.ahc_threshold, config.vbx, config.speaker_keep_threshold)
        return pd.DataFrame({"file_id": group["file_id"].to_numpy(), "chunk_idx": group["chunk_idx"].to_numpy(), "speaker_idx": speaker, "cluster": labels[at, speaker]})

    kind = seg.schema["file_id"].dataType.simpleString()
    return rows.groupBy("file_id").applyInPandas(solve, f"file_id {kind}, chunk_idx int, speaker_idx int, cluster int")


#: Windows of short recordings that a kernel takes together, and the most windows of a short one.
KERNEL_WINDOWS, SHORT_WINDOWS = 1024, 256


def cluster_windows(windows: DataFrame, plda: kernels.Plda, config: PipelineConfig) -> DataFrame:
    """Clusters of the speakers of every window: file_id, chunk_idx, chunks of the recording, width (its highest cluster + 1) and labels.

    A long recording is a kernel by itself, which must fit a worker, short ones share one.
    """
    sizes = windows.groupBy("file_id").agg((F.max("chunk_idx") + 1).alias("chunks"))
    rows = windows.select("file_id", "chunk_idx", "active", "training", "embeddings").join(shuffled(sizes), "file_id")
    buckets = -(-windows.count() // KERNEL_WINDOWS) or 1
    short = F.col("chunks") <= SHORT_WINDOWS
    rows = rows.withColumns({"_alone": F.when(~short, F.col("file_id")), "_bucket": F.when(short, F.pmod(F.xxhash64("file_id"), F.lit(buckets)))})

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["file_id", "chunk_idx"], ignore_index=True)
        recordings = []
        ends = np.flatnonzero(group["file_id"].to_numpy()[1:] != group["file_id"].to_numpy()[:-1]) + 1
        for at in np.split(np.arange(len(group)), ends):
            active, training = (np.stack(group[c].iloc[at].to_list()).astype(bool) for c in ("active", "training"))
            each = group["embeddings"].iloc[at].to_list()
            dim = max(1, max(map(len, each)) // active.shape[1])
            embeddings = np.full((*active.shape, dim), np.nan)
            for k, x in enumerate(each):
                if len(x):
                    embeddings[k] = x.reshape(active.shape[1], dim)
            recordings.append((embeddings[training].astype("float32"), embeddings, active))
        found = kernels.cluster_many(recordings, plda, config.ahc_threshold, config.vbx, config.speaker_keep_threshold)
        widths = np.repeat([x.max() + 1 for x in found], [len(x) for x in found])
        return group[["file_id", "chunk_idx", "chunks"]].assign(width=widths, labels=list(np.concatenate(found)))

    kind = windows.schema["file_id"].dataType.simpleString()
    return rows.groupBy("_alone", "_bucket").applyInPandas(solve, f"file_id {kind}, chunk_idx int, chunks int, width int, labels array<int>")


def after_models(artifacts: Artifacts, plda: kernels.Plda, config: PipelineConfig) -> Result:
    """``post_inference`` of stored windows: only frames with a speaker are ever rows, unless runs of frames are filtered or the dense tables are read."""
    seg, windows, c = artifacts.segmentations, artifacts.windows, config
    labels = materialized(cluster_windows(windows, plda, c), "clusters")
    spoken = frames.spoken(windows, labels, c.step, LOCAL_SPEAKERS)
    if c.smoothing is None:
        chosen = smoothing.settle(spoken, 0.0).select("file_id", "out_frame", "last_frame", F.explode("top").alias("cluster"))
    else:
        picked = smoothing.smoothed(spoken, c.smoothing, keep=["last_frame"])
        chosen = picked.select("file_id", "out_frame", "last_frame", F.posexplode("active").alias("cluster", "_on")).where("_on = 1").drop("_on")
    chosen = materialized(chosen, "chosen")
    counts = frames.speaker_count(seg, c.step)
    clusters = labels.select("file_id", "chunk_idx", F.posexplode("labels").alias("speaker_idx", "cluster"))
    activations = frames.cluster_activations(seg, clusters, c.step, counts)
    on = chosen.select("file_id", "out_frame", "cluster", F.lit(1).alias("active"))
    discrete = activations.join(shuffled(on), ["file_id", "out_frame", "cluster"], "left").na.fill(0, ["active"])
    if c.binarize.min_on > 0 or c.binarize.min_off > 0:
        found = turns.from_frames(_filtered(discrete, c))
    else:
        found = turns.from_active(chosen.select("file_id", F.col("cluster").alias("speaker"), F.col("out_frame").alias("frame"), "last_frame"))
    return Result(artifacts, counts, clusters, activations, discrete, _merged(found, c))


def _filtered(discrete: DataFrame, c: PipelineConfig) -> DataFrame:
    """Scores of frames, runs filtered."""
    scores = discrete.select("file_id", F.col("cluster").alias("speaker"), F.col("out_frame").alias("frame"), F.col("active").cast("double").alias("score"))
    if c.binarize.min_on > 0 or c.binarize.min_off > 0:
        scores = binarize.binarize(scores, c.binarize).withColumn("score", F.col("on").cast("double")).drop("on")
    return scores


def _merged(found: DataFrame, c: PipelineConfig) -> DataFrame:
    return turns.merge(materialized(found, "turns"), c.merge_gap).withColumn("speaker", turns.label(F.col("speaker")))


def post_inference(artifacts: Artifacts, plda: kernels.Plda, config: PipelineConfig | None = None) -> Result:
    """Everything behind the models.  A recording without any speaker has no turns.

    ``artifacts`` should be stored, as they are read several times; counts and clusters are stored here.
    """
    c = config or PipelineConfig()
    if artifacts.windows is not None:
        return after_models(artifacts, plda, c)
    seg = artifacts.segmentations
    counts = materialized(frames.speaker_count(seg, c.step), "counts")
    clusters = materialized(cluster_recordings(artifacts, plda, c), "clusters")
    activations = frames.cluster_activations(seg, clusters, c.step, counts)
    discrete = frames.top_k(activations, counts) if c.smoothing is None else smoothing.smoothed_top_k(activations, counts, c.smoothing)
    return Result(artifacts, counts, clusters, activations, discrete, _merged(turns.from_frames(_filtered(discrete, c)), c))


class Pipeline:
    """Diarization of audio rows (file_id, samples) with a model backend."""

    def __init__(self, backend: Callable[[], seam.ModelBackend], plda: kernels.Plda, config: PipelineConfig | None = None, window: int = int(WINDOW_SECONDS * SAMPLE_RATE), frames_per_window: int = FRAMES_PER_WINDOW):
        self.backend, self.plda, self.config, self.window, self.frames = backend, plda, config or PipelineConfig(), window, frames_per_window

    def runs(self, audio: DataFrame) -> DataFrame:
        """Runs of windows of recordings (file_id, samples)."""
        return layout.runs(audio, self.window, int(self.config.step * SAMPLE_RATE), wav_ranges.RUN)

    def infer(self, runs: DataFrame) -> Artifacts:
        """Models over runs of windows (file_id, run_idx, chunk_idx, chunks, samples), each of them once."""
        step = int(self.config.step * SAMPLE_RATE)
        seg = materialized(seam.segment_runs(runs, self.backend, self.window, step, LOCAL_SPEAKERS, MAX_OVERLAP), "segmentations")
        return Artifacts.of_windows(materialized(seam.embed_runs(seg, self.backend, self.window, step, LOCAL_SPEAKERS), "embeddings"))

    def run_files(self, spark: SparkSession, path: str, **options) -> Result:
        """All PCM files below ``path``, read by byte ranges; files that can't be read, and those shorter than a window, have no turns."""
        runs = wav_ranges.read_runs(spark, path, self.window, int(self.config.step * SAMPLE_RATE), **options)
        return post_inference(self.infer(runs.where("error is null")), self.plda, self.config)

    def run(self, audio: DataFrame) -> Result:
        return post_inference(self.infer(self.runs(audio)), self.plda, self.config)
    #: many recordings are just more rows
    run_batch = run

    def run_stream(self, audio: DataFrame, out: str, available_now: bool = True) -> StreamingQuery:
        """Turns of the recordings of a stream, micro-batch by micro-batch, below ``out``."""
        return queue.start(audio, lambda batch: self.run(batch).segments, out, available_now=available_now)

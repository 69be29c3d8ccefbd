"""The seam where neural models plug in: any object with ``segment`` and ``embed`` on numpy batches.

A backend is made inside each Python worker by a factory, once per task, and gets
whole Arrow batches, so its own batch sizes, devices and sessions stay its affair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.config import MIN_SPEAKER_ACTIVITY
from turnlake.operators import masks as rules
from turnlake.operators import powerset
from turnlake.session import shuffled
from turnlake.sources import audio


class ModelBackend(Protocol):
    def segment(self, windows: np.ndarray) -> np.ndarray:
        """(windows, samples) to logits (windows, frames, classes)."""

    def features(self, samples: np.ndarray, windows: int, window: int, step: int) -> np.ndarray:
        """What ``embed`` needs of each of the neighbouring windows of ``samples``: (windows, ...), made once, whatever masks follow."""

    def embed(self, features: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Features (rows, ...) of each mask's window and masks (rows, frames) to embeddings (rows, dim)."""


def windows_of(samples: np.ndarray, windows: int, window: int, step: int) -> np.ndarray:
    """Neighbouring windows as a view on their samples, padded with zeros behind the end."""
    x = np.zeros((windows - 1) * step + window, "float32")
    x[: len(samples)] = samples[: len(x)]
    return np.lib.stride_tricks.sliding_window_view(x, window)[::step]


class StubBackend:
    """Deterministic stand-in: energies as logits, projected statistics as embeddings."""

    def __init__(self, frames: int = 20, classes: int = 7, dim: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.frames, self.mix, self.project = frames, rng.standard_normal(classes), rng.standard_normal((frames, dim))

    def _energy(self, windows: np.ndarray) -> np.ndarray:
        n = windows.shape[1] // self.frames * self.frames
        return np.sqrt((windows[:, :n].reshape(len(windows), self.frames, -1) ** 2).mean(axis=2))

    def segment(self, windows: np.ndarray) -> np.ndarray:
        return np.sin(20 * self._energy(windows)[:, :, None] * self.mix)

    def features(self, samples: np.ndarray, windows: int, window: int, step: int) -> np.ndarray:
        return self._energy(windows_of(samples, windows, window, step))

    def embed(self, features: np.ndarray, masks: np.ndarray) -> np.ndarray:
        return (features * masks[:, np.arange(self.frames) * masks.shape[1] // self.frames]) @ self.project


def load_onnx(segmentation: str, embedding: str) -> Callable[[], ModelBackend]:
    """A factory of ONNX sessions on local model paths."""

    def make() -> ModelBackend:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        seg, emb = (onnxruntime.InferenceSession(p, options) for p in (segmentation, embedding))

        class Onnx:
            def segment(self, windows):
                return seg.run(None, {seg.get_inputs()[0].name: windows[:, None, :].astype("float32")})[0]

            def features(self, samples, windows, window, step):
                return audio.run_filter_banks(samples, windows, window, step)

            def embed(self, features, masks):
                names = [i.name for i in emb.get_inputs()]
                return emb.run(None, dict(zip(names, (features.astype("float32"), masks.astype("float32")))))[0]

        return Onnx()

    return make


def segment(runs: DataFrame, backend: Callable[[], ModelBackend], window: int, step: int) -> DataFrame:
    """Runs of windows (file_id, chunk_idx, chunks, samples) to a row (file_id, chunk_idx, frame_idx, logits) per frame.

    Samples travel once a run; its windows are views on them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        for batch in batches:
            for file_id, first, n, samples in zip(batch["file_id"], batch["chunk_idx"], batch["chunks"], batch["samples"]):
                logits = model.segment(windows_of(samples, n, window, step))
                yield pd.DataFrame({"file_id": [file_id] * n, "chunk_idx": np.arange(first, first + n, dtype="int32"), "logits": [x.astype("float32").tolist() for x in logits]})

    kind = runs.schema["file_id"].dataType.simpleString()
    rows = runs.select("file_id", "chunk_idx", "chunks", "samples").mapInPandas(run, f"file_id {kind}, chunk_idx int, logits array<array<float>>")
    return rows.select("file_id", "chunk_idx", F.posexplode("logits").alias("frame_idx", "logits"))


def embed(runs: DataFrame, masks: DataFrame, backend: Callable[[], ModelBackend], window: int, step: int, run: int, min_activity: float = MIN_SPEAKER_ACTIVITY) -> DataFrame:
    """Embeddings of (file_id, chunk_idx, speaker_idx, mask) rows over their windows; null below ``min_activity``.

    Inactive speakers are left out before the model runs, as no filter reaches through it.
    All masks of a run of ``run`` windows meet its samples in one row, so these are sent
    once, and the features of a window are made once for all its masks.
    """
    activity = F.aggregate("mask", F.lit(0.0), lambda s, x: s + x)
    on = ["file_id", "run_idx"]
    asked = masks.where(activity >= min_activity).withColumn("run_idx", F.floor(F.col("chunk_idx") / run).cast("int"))
    # at most run * local speakers masks
    asked = asked.groupBy(*on).agg(F.collect_list(F.struct("chunk_idx", "speaker_idx", "mask")).alias("masks"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        for batch in batches:
            for file_id, first, n, samples, rows in zip(batch["file_id"], batch["chunk_idx"], batch["chunks"], batch["samples"], batch["masks"]):
                features = model.features(samples, n, window, step)
                chunk = np.array([r["chunk_idx"] for r in rows])
                found = model.embed(features[chunk - first], np.stack([np.asarray(r["mask"], "float64") for r in rows]))
                yield pd.DataFrame({"file_id": [file_id] * len(rows), "chunk_idx": chunk, "speaker_idx": [r["speaker_idx"] for r in rows], "embedding": [x.astype("float32") for x in found]})

    kind = runs.schema["file_id"].dataType.simpleString()
    met = asked.join(shuffled(runs.select(*on, "chunk_idx", "chunks", "samples")), on)
    done = met.select("file_id", "chunk_idx", "chunks", "samples", "masks").mapInPandas(solve, f"file_id {kind}, chunk_idx int, speaker_idx int, embedding array<float>")
    key = ["file_id", "chunk_idx", "speaker_idx"]
    return masks.select(*key).join(shuffled(done), key, "left")


#: Samples of the runs in a batch that a task hands on.
BATCH_SAMPLES = 4 << 20
WINDOW_COLUMNS = "chunk_idx int, on array<int>, active array<boolean>, training array<boolean>, asked array<boolean>, embeddings array<float>"


def segment_runs(runs: DataFrame, backend: Callable[[], ModelBackend], window: int, step: int, speakers: int, most: int) -> DataFrame:
    """Runs of windows with their samples and ``on``, the active speakers of each frame of each window as bits.

    Many short recordings are few batches, and rows aren't frames until speakers are known.
    """
    bits = np.array([sum(a << k for k, a in enumerate(row)) for row in powerset.mapping(speakers, most)], "int32")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        for batch in batches:
            for part in _parts(batch):
                on = []
                for n, samples in zip(part["chunks"], part["samples"]):
                    logits = np.asarray(model.segment(windows_of(samples, n, window, step)), "float32")
                    # the last of equal classes, as in powerset.argmax_last
                    on.append(bits[logits.shape[2] - 1 - logits[:, :, ::-1].argmax(axis=2)].ravel())
                yield part.assign(on=on)

    kind = runs.schema["file_id"].dataType.simpleString()
    return runs.select("file_id", "chunk_idx", "chunks", "samples").mapInPandas(run, f"file_id {kind}, chunk_idx int, chunks int, samples array<float>, on array<int>")


def _parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows in parts of some ``BATCH_SAMPLES`` samples."""
    part = (np.cumsum([len(x) for x in batch["samples"]]) - 1) // BATCH_SAMPLES
    for at in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(part)) + 1):
        if len(at):
            yield batch.iloc[at]


def embed_runs(segmented: DataFrame, backend: Callable[[], ModelBackend], window: int, step: int, speakers: int, min_activity: float = MIN_SPEAKER_ACTIVITY) -> DataFrame:
    """A row (file_id and ``WINDOW_COLUMNS``) per window of ``segment_runs``: who is active, whose embedding is asked for and trains, embeddings one behind the other.

    The rules are those of ``masks``; rows of speakers without an embedding are NaN, and
    windows without any have none.
    """

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        for batch in batches:
            for part in _parts(batch):
                rows = []
                for file_id, first, n, samples, on in zip(part["file_id"], part["chunk_idx"], part["chunks"], part["samples"], part["on"]):
                    on = on.reshape(n, -1)
                    active = (on[:, None, :] >> np.arange(speakers)[:, None] & 1).astype("float64")
                    mask, single = rules.chosen_masks(active, window, min_activity=min_activity)
                    asked = mask.sum(axis=2) >= min_activity
                    found = model.embed(model.features(samples, n, window, step)[np.nonzero(asked)[0]], mask[asked]) if asked.any() else np.zeros((0, 0))
                    vectors = np.full((n, speakers, found.shape[1]), np.nan, "float32")
                    vectors[asked] = found
                    training = asked & np.isfinite(vectors).all(axis=2) & rules.trains(single, on.shape[1])
                    some = asked.any(axis=1)
                    rows += [(file_id, first + k, on[k], active[k].any(axis=1), training[k], asked[k], vectors[k].ravel() if some[k] else vectors[k, 0, :0]) for k in range(n)]
                yield pd.DataFrame(rows, columns=["file_id", *[c.split()[0] for c in WINDOW_COLUMNS.split(", ")]])

    kind = segmented.schema["file_id"].dataType.simpleString()
    return segmented.mapInPandas(solve, f"file_id {kind}, {WINDOW_COLUMNS}")

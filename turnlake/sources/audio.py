"""Audio: PCM scan, resampling, filter-bank features and pooling, all in batches on Arrow."""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.config import SAMPLE_RATE
from turnlake.sources.wav_ranges import AudioError, find_pcm, to_float


def decode_wav(raw: bytes, rate: int | None = None) -> tuple[np.ndarray, int]:
    """Samples in [-1, 1) and rate of a 16-bit mono PCM file; chunks of odd size are padded by a byte.  With ``rate``, others are refused."""
    pcm = find_pcm(lambda at, n: raw[at : at + n], len(raw), rate)
    return to_float(raw[pcm.at : pcm.at + 2 * pcm.n_samples]), pcm.rate


def encode_wav(samples: np.ndarray, rate: int = SAMPLE_RATE) -> bytes:
    body = np.clip(np.round(np.asarray(samples) * 32768), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return decode(files.select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("file_id"), "content"))


def decode(files: DataFrame) -> DataFrame:
    """file_id, samples, sample_rate, duration, error of (file_id, content) rows; a bad file gives an error, not a failure."""

    @F.pandas_udf("samples array<float>, sample_rate int, error string")
    def scan(raws: pd.Series) -> pd.DataFrame:
        out = []
        for raw in raws:
            try:
                samples, rate = decode_wav(raw)
                out.append((samples, rate, None))
            except (AudioError, struct.error) as e:
                out.append((None, None, str(e)))
        return pd.DataFrame(out, columns=["samples", "sample_rate", "error"]).astype({"sample_rate": "Int32"})

    rows = files.withColumn("_a", scan("content")).select("file_id", "_a.*")
    return rows.withColumn("duration", F.try_divide(F.size("samples"), F.col("sample_rate")))


def resample(samples: np.ndarray, rate: int, to: int = SAMPLE_RATE) -> np.ndarray:
    """Mean of channels, then nearest lower sample."""
    x = np.asarray(samples, "float32")
    x = x.mean(axis=1) if x.ndim == 2 else x
    if rate == to:
        return x
    at = (np.arange(int(len(x) * to / rate)) * (rate / to)).astype("int64")
    return x[np.minimum(at, len(x) - 1)]


@functools.cache
def mel_bank(bins: int = 80, fft: int = 512, rate: int = SAMPLE_RATE, low: float = 20.0) -> np.ndarray:
    """Triangles evenly spaced on the mel scale (1127 ln(1 + f / 700)), one row per bin over the FFT's lower half."""
    mel = lambda f: 1127.0 * np.log(1.0 + np.asarray(f) / 700.0)
    edges = np.linspace(mel(low), mel(rate / 2), bins + 2)
    m = mel(np.arange(fft // 2 + 1) * rate / fft)
    up = (m - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - m) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


FBANK_HOP, FBANK_FRAME = 160, 400


def log_mel(samples: np.ndarray) -> np.ndarray:
    """Log mel energies (frames, 80): 25 ms frames every 10 ms, pre-emphasis .97, Hamming window.  A frame depends on its own samples only."""
    x = np.asarray(samples, "float64") * (1 << 15)
    if len(x) < 400:
        return np.zeros((0, 80), "float32")
    frames = np.lib.stride_tricks.sliding_window_view(x, 400)[::160]
    frames = frames - frames.mean(axis=1, keepdims=True)
    frames = frames - 0.97 * np.concatenate([frames[:, :1], frames[:, :-1]], axis=1)
    power = np.abs(np.fft.rfft(frames * np.hamming(400), 512)) ** 2
    return np.log(np.maximum(np.finfo("float32").eps, power @ mel_bank().T))


def energies(files: DataFrame) -> DataFrame:
    """file_id, frames, bins, energy (the sum of the log mel energies), error of (file_id, content) rows.

    A recording is decoded and summed up before the next one, so a task holds the files of
    its batch and the samples and energies of one of them.
    """
    fields = [("frames", pa.int32()), ("bins", pa.int32()), ("energy", pa.float64()), ("error", pa.string())]

    def total(raw: bytes | None) -> tuple:
        if raw is None:
            return None, None, None, "no content"
        try:
            logs = log_mel(decode_wav(raw)[0])
        except (AudioError, struct.error) as e:
            return None, None, None, str(e)
        return *logs.shape, float(logs.sum()), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [total(raw.as_py()) for raw in batch.column(1)]
            yield pa.record_batch([batch.column(0), *[pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)]], names=["file_id", *[n for n, _ in fields]])

    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "content").mapInArrow(run, f"file_id {kind}, frames int, bins int, energy double, error string")


def filter_bank(samples: np.ndarray) -> np.ndarray:
    """Log mel energies (frames, 80), mean over time removed."""
    logs = log_mel(samples)
    return (logs - logs.mean(axis=0)).astype("float32") if len(logs) else logs


def run_filter_banks(samples: np.ndarray, windows: int, window: int, step: int) -> np.ndarray:
    """The filter banks (windows, frames, 80) of neighbouring windows of ``samples``, padded with zeros behind the end.

    Energies are computed once for all windows if ``step`` is whole hops; each window
    takes its frames of them and removes its own mean.
    """
    x = np.zeros((windows - 1) * step + window, "float32")
    x[: len(samples)] = samples[: len(x)]
    if step % FBANK_HOP:
        return np.stack([filter_bank(x[i * step : i * step + window]) for i in range(windows)])
    logs, frames = log_mel(x), max(0, (window - FBANK_FRAME) // FBANK_HOP + 1)
    parts = np.stack([logs[i * step // FBANK_HOP :][:frames] for i in range(windows)])
    return (parts - parts.mean(axis=1, keepdims=True)).astype("float32") if frames else parts


def pool_statistics(features: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Weighted mean and unbiased deviation of (channels, frames) features; the mask is stretched to the nearest frame."""
    frames = features.shape[1]
    w = np.asarray(mask, "float64")[(np.arange(frames) * len(mask) // frames)]
    total = w.sum()
    if total == 0:
        return np.concatenate([np.zeros(len(features)), np.full(len(features), 1e-5)])
    mean = features @ w / total
    spread = ((features - mean[:, None]) ** 2) @ w / (total - (w * w).sum() / total + 1e-8)
    return np.concatenate([mean, np.sqrt(np.maximum(spread, 1e-10))])


def features(chunks: DataFrame) -> DataFrame:
    """Adds fbank array<array<float>> to rows with samples; one pass per batch, shared by a chunk's speakers."""

    @F.pandas_udf("array<array<float>>")
    def bank(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for samples in batches:
            yield pd.Series([filter_bank(np.asarray(s)).tolist() for s in samples])

    return chunks.withColumn("fbank", bank("samples"))

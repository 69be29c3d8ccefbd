"""Windows over audio and their place on the output frame grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.config import FRAME_DURATION, FRAME_STEP, WINDOW_SECONDS


def window_count(length: Column, window: int, step: int) -> Column:
    """Full windows, and one padded tail where samples are left over behind the last; none if shorter than one window."""
    full = F.floor((length - window) / step).cast("int") + 1
    return F.when(length < window, 0).otherwise(full + F.when((length > window) & (full.cast("long") * step < length), 1).otherwise(0)).cast("int")


def windows(files: DataFrame, window: int, step: int, length: str = "n_samples") -> DataFrame:
    """One row per window: the columns of ``files`` and chunk_idx, start_sample, is_padded."""
    n = window_count(F.col(length), window, step)
    rows = files.withColumn("chunk_idx", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))))
    rows = rows.withColumn("start_sample", F.col("chunk_idx").cast("long") * F.lit(step))
    return rows.withColumn("is_padded", F.col("start_sample") + window > F.col(length))


def runs(files: DataFrame, window: int, step: int, run: int, samples: str = "samples") -> DataFrame:
    """Rows of ``run`` neighbouring windows, which hold the samples that these share once: the other columns, run_idx, chunk_idx of the first, chunks, samples.

    The parts are cut inside the row, so that the recording isn't copied for each.
    """
    n = window_count(F.size(samples), window, step)
    first = F.sequence(F.lit(0), F.greatest(F.ceil(n / run).cast("int") - 1, F.lit(0)))
    here = lambda r: F.least(F.lit(run), n - r * run)
    part = lambda r: F.slice(samples, r * (run * step) + 1, (here(r) - 1) * step + window)
    cut = F.transform(first, lambda r: F.struct(r.alias("run_idx"), (r * run).alias("chunk_idx"), here(r).alias("chunks"), part(r).alias("samples")))
    others = [c for c in files.columns if c != samples]
    return files.where(n > 0).select(*others, F.explode(cut).alias("_r")).select(*others, "_r.*")


def chunk_slice(samples, chunk: Column, window: int, step: int) -> Column:
    """Samples of a window, not padded; empty behind the end."""
    start, n = chunk * step, F.size(samples)
    return F.when(start >= n, F.slice(samples, F.lit(1), F.lit(0))).otherwise(F.slice(samples, start + 1, F.least(F.lit(window), n - start)))


def padded_slice(samples, chunk: Column, window: int, step: int) -> Column:
    part = chunk_slice(samples, chunk, window, step)
    return F.concat(part, F.array_repeat(F.lit(0.0).cast("float"), F.lit(window) - F.size(part)))


def start_frame(chunk: Column, step: float, frame_step: float = FRAME_STEP) -> Column:
    """Output frame at which a chunk starts, halves away from zero."""
    return F.round(chunk * F.lit(step) / F.lit(frame_step)).cast("int")


def output_extent(chunks: Column, step: float, frame_step: float = FRAME_STEP, window: float = WINDOW_SECONDS, frame_duration: float = FRAME_DURATION) -> Column:
    """Output frames that ``chunks`` windows cover; 0 without any."""
    end = F.lit(window) + (chunks - 1) * F.lit(step) + F.lit(0.5 * frame_duration)
    return F.when(chunks == 0, 0).otherwise(F.round((end - F.lit(0.5 * frame_duration)) / F.lit(frame_step)).cast("int") + 1)


def frame_time(frame: Column, frame_step: float = FRAME_STEP, frame_duration: float = FRAME_DURATION) -> Column:
    """Midpoint of a frame in seconds."""
    return frame * F.lit(frame_step) + F.lit(0.5 * frame_duration)


def to_output_frames(rows: DataFrame, step: float) -> DataFrame:
    """Adds out_frame to (file_id, chunk_idx, frame_idx) rows and drops frames behind the file's extent."""
    ends = rows.groupBy("file_id").agg((F.max("chunk_idx") + 1).alias("_chunks"))
    placed = rows.withColumn("out_frame", start_frame(F.col("chunk_idx"), step) + F.col("frame_idx"))
    return placed.join(ends, "file_id").where(F.col("out_frame") < output_extent(F.col("_chunks"), step)).drop("_chunks")

"""PCM recordings read by byte ranges, as a Spark data source.

A recording of any length is many partitions: plans cut files into ranges of bytes by
their sizes alone, and a task reads a file's header and then only the bytes of what
begins in its ranges.  Small files share a partition.  Rows are runs of neighbouring
windows, which hold the samples that the windows share once, so no row holds a whole
recording and no sample is sent once per window.

    spark.dataSource.register(WavRuns)
    spark.read.format("wav_runs").option("window", 160000).option("step", 16000).load(folder)
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

RUN_SCHEMA = "file_id string, run_idx int, chunk_idx int, chunks int, start_sample long, n_samples long, sample_rate int, samples array<float>, error string"
RANGE_BYTES = 32 << 20
#: Windows in a run.
RUN = 16
#: Bytes of samples in a batch that a task hands on.
BATCH_BYTES = 16 << 20
#: Partitions a core, in which neighbouring ranges share one, up to ``RANGE_BYTES``, if there are more.
PARTITIONS = 4


class AudioError(ValueError):
    pass


@dataclass(frozen=True)
class Pcm:
    """Where a file's samples are: first byte, number, rate."""

    at: int
    n_samples: int
    rate: int


def find_pcm(fetch: Callable[[int, int], bytes], size: int, rate: int | None = None) -> Pcm:
    """The samples of a 16-bit mono PCM file of ``size`` bytes, read by ``fetch(offset, bytes)``; chunks of odd size are padded by a byte.

    Only chunk headers are read.  With ``rate``, other rates are refused.
    """
    head = fetch(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise AudioError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", fetch(at, 8))
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", fetch(at + 8, 16))
            if form[0] != 1 or form[1] != 1 or form[5] != 16:
                raise AudioError("only 16-bit mono PCM is read")
            if rate and form[2] != rate:
                raise AudioError(f"only {rate} samples a second are read")
        elif name == b"data":
            if form is None:
                raise AudioError("data before fmt")
            return Pcm(at + 8, min(length, size - at - 8) // 2, form[2])
        at += 8 + length + length % 2
    raise AudioError("no data")


def to_float(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i2").astype("float32") / np.float32(32768)


def window_count(samples: int, window: int, step: int) -> int:
    """Full windows, and one padded tail where samples are left over behind the last; none if shorter than one window."""
    if samples < window:
        return 0
    full = (samples - window) // step + 1
    return full + (samples > window and full * step < samples)


@dataclass(frozen=True)
class Range(InputPartition):
    """Parts (path, size, from, to) of files; a run belongs to the part in which its first byte is."""

    parts: tuple[tuple[str, int, int, int], ...]


def plan(files: list[tuple[str, int]], range_bytes: int) -> list[Range]:
    """Ranges of some ``range_bytes``; each file is covered without gaps from byte 0 to its end, an empty one by (0, 1)."""
    out, held, room = [], [], range_bytes
    for path, size in files:
        lo, end = 0, max(size, 1)
        while lo < end:
            hi = min(end, lo + room)
            held.append((path, size, lo, hi))
            room -= hi - lo
            lo = hi
            if not room:
                out.append(Range(tuple(held)))
                held, room = [], range_bytes
    return out + ([Range(tuple(held))] if held else [])


def bundled(ranges: list[Range], partitions: int) -> list[Range]:
    """Neighbouring ranges in some ``partitions`` or more: a task takes longer to begin than to read a few short files."""
    size = sum(hi - lo for r in ranges for _, _, lo, hi in r.parts)
    room = min(size / partitions, RANGE_BYTES)
    out: list[list] = []
    held = 0
    for r in ranges:
        length = sum(hi - lo for _, _, lo, hi in r.parts)
        if not out or held + length > room:
            out.append([])
            held = 0
        out[-1] += r.parts
        held += length
    return [Range(tuple(x)) for x in out]


@dataclass
class _Layout:
    window: int
    step: int
    run: int
    pieces: bool

    def runs(self, pcm: Pcm) -> int:
        """Runs of a file; in pieces, all samples are in some run, and an empty file has one."""
        if self.pieces:
            return max(1, -(-pcm.n_samples // (self.run * self.step)))
        return -(-window_count(pcm.n_samples, self.window, self.step) // self.run)

    def windows(self, pcm: Pcm, run: int) -> int:
        if self.pieces:
            return min(self.run, max(0, -(-pcm.n_samples // self.step) - run * self.run))
        return min(self.run, window_count(pcm.n_samples, self.window, self.step) - run * self.run)


def read_part(fetch: Callable[[int, int], bytes], size: int, lo: int, hi: int, layout: _Layout, rate: int | None) -> Iterator[tuple]:
    """Rows behind file_id of ``RUN_SCHEMA`` of the runs that begin in bytes ``lo`` to ``hi``; a file that can't be read is a row with its error, in its first part."""
    try:
        pcm = find_pcm(fetch, size, rate)
    except (AudioError, struct.error) as e:
        if lo == 0:
            yield None, None, None, None, None, None, None, str(e)
        return
    stride = layout.run * layout.step
    # the first run belongs to the part with the header
    first = 0 if lo == 0 else max(1, -(-(lo - pcm.at) // (2 * stride)))
    for run in range(first, layout.runs(pcm)):
        start, n = run * stride, layout.windows(pcm, run)
        if run and pcm.at + 2 * start >= hi:
            break
        stop = min(pcm.n_samples, start + max(0, n - 1) * layout.step + layout.window)
        yield run, run * layout.run, n, start, pcm.n_samples, pcm.rate, to_float(fetch(pcm.at + 2 * start, 2 * max(0, stop - start))), None


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def file_id(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".wav")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        number = lambda name, default: int(options.get(name, default))
        self.path, self.range_bytes, self.rate = options["path"], number("rangeBytes", RANGE_BYTES), number("rate", 0) or None
        self.most = number("partitions", 0)
        window = number("window", 160_000)
        self.layout = _Layout(window, number("step", window), number("run", RUN), options.get("pieces", "false").lower() == "true")
        if self.layout.pieces and self.layout.step != window:
            raise ValueError("pieces don't overlap: leave step out")
        self.only: set[str] | None = None

    def partitions(self) -> Sequence[Range]:
        fs, path = _open(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.is_file and x.path.endswith(".wav") and (self.only is None or file_id(x.path) in self.only))
        ranges = plan(files, self.range_bytes)
        return bundled(ranges, self.most) if self.most else ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float32()), pa.string()]
        names = [x.split()[0] for x in RUN_SCHEMA.split(", ")]
        rows, held = [], 0
        batch = lambda: pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)
        for path, size, lo, hi in partition.parts:
            with fs.open_input_file(path) as f:

                def fetch(offset: int, length: int, f=f) -> bytes:
                    f.seek(offset)
                    return f.read(length)

                for row in read_part(fetch, size, lo, hi, self.layout, self.rate):
                    rows.append((file_id(path), *row))
                    held += 4 * len(row[6]) if row[6] is not None else 0
                    if held > BATCH_BYTES:
                        yield batch()
                        rows.clear()
                        held = 0
        if rows:
            yield batch()


class _FilteringReader(_Reader):
    """Spark refuses a reader with this method unless spark.sql.python.filterPushdown.enabled is true."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and lists of file_id choose files; other filters stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("file_id",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = values if self.only is None else self.only & values
            else:
                yield f


class WavRuns(DataSource):
    """Options: path; window and step in samples (step: window); run, windows a row; rangeBytes; partitions, beyond which short ranges share one; rate, the only one read;
    pieces (true: non-overlapping windows that cover all samples of all files, the last one short); filters (true: filters on
    file_id choose files before any is opened; needs spark.sql.python.filterPushdown.enabled)."""

    @classmethod
    def name(cls) -> str:
        return "wav_runs"

    def schema(self) -> str:
        return RUN_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_FilteringReader if self.options.get("filters") == "true" else _Reader)(self.options)


def read_runs(spark: SparkSession, path: str, window: int, step: int | None = None, **options) -> DataFrame:
    """Runs of windows of the PCM files below ``path``: rows of ``RUN_SCHEMA``."""
    spark.dataSource.register(WavRuns)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("wav_runs").option("window", window).option("step", step or window).option("filters", filters).option("partitions", PARTITIONS * spark.sparkContext.defaultParallelism)
    for name, value in options.items():
        reader = reader.option(name, str(value).lower() if isinstance(value, bool) else value)
    return reader.load(path)

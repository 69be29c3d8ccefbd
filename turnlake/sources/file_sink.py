"""A sink of one file per name, committed once.

Tasks write into folders of their attempt.  Only the attempts that Spark accepts are
moved into place, when all of them are there; others are deleted, so a retried or a
speculative task leaves nothing.  A file's content is the concatenation of its rows in
their order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from turnlake.sources.annotations import exact_rttm_lines
from turnlake.sources.wav_ranges import _open


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.stage = path.rstrip("/"), f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _open(self.path)
        context = TaskContext.get()
        folder = f"{base}/{self.stage}/{context.taskAttemptId() if context else uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        names: list[str] = []
        out = None
        try:
            for batch in iterator:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if not names or name != names[-1]:
                        if out:
                            out.close()
                        if not name or "/" in name or name.startswith(("_", ".")) or name in names[-1:]:
                            raise ValueError(f"no file name: {name!r}")
                        out = fs.open_output_stream(f"{folder}/{name}")
                        names.append(name)
                    out.write(content or b"")
        finally:
            if out:
                out.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = _open(self.path)
        fs.create_dir(base, recursive=True)
        names = [n for m in messages if m for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one name are in several places; see write_files")
        for m in messages:
            for name in m.names if m else []:
                fs.move(f"{m.folder}/{name}", f"{base}/{name}")
        fs.delete_dir(f"{base}/{self.stage}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = _open(self.path)
        if fs.get_file_info(f"{base}/{self.stage}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{base}/{self.stage}")


class NamedFiles(DataSource):
    """Rows (name string, content binary), those of a name in a row, as files below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def write_files(rows: DataFrame, path: str, name: Column, content: Column, *order: Column) -> None:
    """A file per ``name`` with its ``content`` in ``order``; all of one name is written by one task, row by row."""
    rows.sparkSession.dataSource.register(NamedFiles)
    table = rows.select(name.alias("name"), content.cast("binary").alias("content"), *[c.alias(f"_{i}") for i, c in enumerate(order)])
    sorted_ = table.repartition("name").sortWithinPartitions("name", *[f"_{i}" for i in range(len(order))])
    sorted_.select("name", "content").write.format("named_files").mode("append").save(path)


def write_annotations(turns: DataFrame, path: str, digits: int = 6) -> None:
    """One RTTM file per recording, ``<file_id>.rttm``, its turns by start, then end and speaker."""
    columns = turns.select(F.col("file_id").cast("string").alias("file_id"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col("speaker").cast("string").alias("speaker"))
    lines = exact_rttm_lines(columns, digits, keep=["file_id", "start", "end", "speaker"])
    write_files(lines, path, F.concat("file_id", F.lit(".rttm")), F.concat("value", F.lit("\n")), F.col("start"), F.col("end"), F.col("speaker"))

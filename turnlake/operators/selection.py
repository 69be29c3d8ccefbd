"""Choice of recordings: pairing of audio and annotation, and a budget of files and minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stem(path) -> F.Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def paired(audio: DataFrame, annotations: DataFrame, path: str = "path") -> DataFrame:
    """Audio and annotation files with one stem: stem, audio, annotation."""
    left = audio.select(stem(F.col(path)).alias("stem"), F.col(path).alias("audio"))
    return left.join(annotations.select(stem(F.col(path)).alias("stem"), F.col(path).alias("annotation")), "stem")


def missing(audio: DataFrame, annotations: DataFrame, path: str = "path") -> DataFrame:
    """Stems of annotations without audio."""
    return annotations.select(stem(F.col(path)).alias("stem")).join(audio.select(stem(F.col(path)).alias("stem")), "stem", "left_anti")


def budgeted(files: DataFrame, max_files: int, max_seconds: float, duration: str = "duration", idx: str = "idx") -> DataFrame:
    """Shortest files first, until ``max_files`` or until the next one would pass ``max_seconds``; the first always counts.

    A chosen file has fewer than ``max_files`` before it, so only the shortest
    ``max_files`` are ever put in order, by a distributed top-k.
    """
    short = files.orderBy(duration, idx).limit(max_files)
    order = W.orderBy(duration, idx)
    rows = short.withColumns({"_nth": F.row_number().over(order), "_sum": F.sum(duration).over(order.rowsBetween(W.unboundedPreceding, 0))})
    return rows.where((F.col("_nth") == 1) | (F.col("_sum") <= max_seconds)).drop("_nth", "_sum")

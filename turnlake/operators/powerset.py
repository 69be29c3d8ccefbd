"""Powerset classes: sets of simultaneous speakers, by size and then in order."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def mapping(speakers: int, most: int) -> list[list[int]]:
    """The 0/1 row of each class."""
    sets = [s for size in range(most + 1) for s in combinations(range(speakers), size)]
    return [[int(k in s) for k in range(speakers)] for s in sets]


def class_count(speakers: int, most: int) -> int:
    return len(mapping(speakers, most))


def mapping_table(spark: SparkSession, speakers: int, most: int) -> DataFrame:
    rows = [(c, k, a) for c, row in enumerate(mapping(speakers, most)) for k, a in enumerate(row)]
    return spark.createDataFrame(rows, "class_idx int, speaker_idx int, active int")


def argmax_last(values) -> Column:
    """Index of the largest element, the last of equal ones."""
    return F.array_max(F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))["i"]


def decode(rows: DataFrame, speakers: int, most: int, logits: str = "logits") -> DataFrame:
    """Adds class_idx and speaker_idx, active: a row per local speaker of every frame."""
    literal = F.array(*[F.array(*[F.lit(float(a)) for a in row]) for row in mapping(speakers, most)])
    return rows.withColumn("class_idx", argmax_last(logits)).select("*", F.posexplode(F.element_at(literal, F.col("class_idx") + 1)).alias("speaker_idx", "active"))


def encode(rows: DataFrame, speakers: int, most: int, mask: str = "mask") -> DataFrame:
    """Adds class_idx of a 0/1 array; null for a set that is no class."""
    sets = F.array(*[F.array(*[F.lit(float(a)) for a in row]) for row in mapping(speakers, most)])
    place = F.array_position(sets, F.transform(F.col(mask), lambda x: x.cast("double")))
    return rows.withColumn("class_idx", F.when(place > 0, (place - 1).cast("int")))

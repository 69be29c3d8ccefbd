"""Scans of a group's rows in slices of its order, and joins of points with intervals that hold them.

A scan over the rows of one recording needs only a row or a number of all that was
before.  Where recordings are long they are cut into slices of time: each slice is
scanned by itself, one row per slice is carried over to the slices behind it, and the
two are put together.  So a recording of any length is many tasks, and the only window
over a whole recording has a row per slice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.session import materialized

#: Rows of a slice on average, in the densest of the recordings that are cut.
SLICE_ROWS = 100_000
SLICE = "_slice"


def width(rows: DataFrame, by: list[str], at: str, size: int | None = None) -> float | None:
    """The length of a slice at which the densest long group has some ``SLICE_ROWS`` rows in each; None if no group is longer than that."""
    size = size or SLICE_ROWS
    spans = rows.groupBy(*by).agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(F.lit(1)).alias("n")).where((F.col("n") > size) & (F.col("hi") > F.col("lo")))
    found = spans.agg(F.min((F.col("hi") - F.col("lo")) / F.ceil(F.col("n") / size))).first()[0]
    return float(found) if found else None


def sliced(rows: DataFrame, at: str, length: float) -> DataFrame:
    """Adds the slice; written once, as slices are scanned and summed up apart."""
    return materialized(rows.withColumn(SLICE, F.floor(F.col(at) / F.lit(length))), "slices")


def carried(rows: DataFrame, by: list[str], kept: dict[str, Column], carry: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds columns of what other slices hold, from an aggregate ``kept`` by slice.

    ``carry`` gives for each new column one of ``kept`` and what is wanted of it: its
    max or sum over all earlier slices, the last of it that isn't null, that of the
    slice before or of the one behind.
    """
    order = W.partitionBy(*by).orderBy(SLICE)
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    ways = {
        "max": lambda c: F.max(c).over(earlier), "sum": lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)), "last": lambda c: F.last(c, ignorenulls=True).over(earlier),
        "before": lambda c: F.lag(c).over(order), "behind": lambda c: F.lead(c).over(order),
    }
    slices = rows.groupBy(*by, SLICE).agg(*[c.alias(name) for name, c in kept.items()])
    slices = slices.select(*by, SLICE, *[ways[way](name).alias(new) for new, (name, way) in carry.items()])
    return rows.join(slices, [*by, SLICE])


def spread(intervals: DataFrame, start: str, end: str) -> tuple[float, int]:
    """The base cell, a mean interval, and how many doublings of it the longest interval takes."""
    sizes = intervals.select((F.col(end) - F.col(start)).cast("double").alias("x")).where("x > 0")
    mean, longest = sizes.agg(F.avg("x"), F.max("x")).first()
    return (mean, max(0, math.ceil(math.log2(longest / mean)))) if mean else (1.0, 0)


def dyadic_cells(start: Column, end: Column, levels: int) -> Column:
    """The cells (level, cell) of an interval of base cells: disjoint, twice ``levels`` and a few at most; cell c of level l is base cells c * 2^l to (c + 1) * 2^l."""

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        s, e = F.ceil(start / size), F.floor(end / size)
        inside = s < e
        # on the top level whatever is left; below it, what the level above can't hold
        left, right = inside & (F.pmod(s, F.lit(2)) == 1), inside & (F.pmod(e, F.lit(2)) == 1)
        ends = F.array(F.when(left, s), F.when(right, e - 1))
        whole = F.when(inside, F.sequence(s, e - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
        cells = F.when(level == levels, whole).otherwise(ends)
        return F.transform(F.filter(cells, lambda c: c.isNotNull()), lambda c: F.struct(level.cast("int").alias("level"), c.cast("long").alias("cell")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def stab(points: DataFrame, intervals: DataFrame, by: list[str], point: str, start: str, end: str, cells_of: tuple[float, int] | None = None) -> DataFrame:
    """Pairs of a row of ``points`` and a row of ``intervals`` of its group with start <= point < end.

    An interval is in a few cells of lengths that double from that of a mean interval; a
    point is in one cell of each length.  A point meets an interval in one cell only, and
    an interval of any length is a number of rows in the logarithm of it.  Other columns
    of the two must have different names.
    """
    base, levels = cells_of or spread(intervals, start, end)
    unit = F.lit(base)
    cells = dyadic_cells(F.floor(F.col(start) / unit), F.ceil(F.col(end) / unit), levels)
    held = intervals.where(F.col(end) > F.col(start)).withColumn("_c", F.explode(cells))
    above = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.struct(level.cast("int").alias("level"), F.floor(F.floor(F.col(point) / unit) / F.pow(F.lit(2.0), level)).alias("cell")))
    met = points.withColumn("_c", F.explode(above)).join(held, [*by, "_c"])
    return met.where((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end))).drop("_c")


def overlaps(left: DataFrame, right: DataFrame, by: list[str], start: str, end: str, other_start: str, other_end: str) -> DataFrame:
    """Pairs of intervals of a group that share more than a point, each once: one of the two starts inside the other."""
    a, b = left.where(F.col(end) > F.col(start)), right.where(F.col(other_end) > F.col(other_start))
    both = spread(a.select(F.col(start).alias("s"), F.col(end).alias("e")).unionAll(b.select(other_start, other_end)), "s", "e")
    first = stab(a, b, by, start, other_start, other_end, both)
    second = stab(b, a, by, other_start, start, end, both).where(F.col(other_start) > F.col(start))
    return first.unionByName(second)

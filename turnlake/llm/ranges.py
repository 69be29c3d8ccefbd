"""Range lookup in a bounded, sorted list of cuts, as a native column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are the runs between these characters (a regular-expression class).
BLANK = r"[\x20\x09-\x0D]"
NOT_BLANK = r"[^\x20\x09-\x0D]"


def long_array(values: list[int]) -> Column:
    """A constant array of longs, folded once by the optimizer."""
    if not values:
        return F.expr("cast(array() as array<bigint>)")
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def range_index(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at or below ``value``: two short scans, blocks and then one block.

    ``value`` should be a plain column, as it is read once per comparison.
    """
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    blocks = F.size(F.filter(long_array(cuts[step - 1 :: step]), lambda c: c <= value))
    inner = F.transform(F.array(blocks), lambda b: b * step + F.size(F.filter(F.slice(long_array(cuts), b * step + 1, F.lit(step)), lambda c: c <= value)))
    return F.element_at(inner, 1)

"""Binary search in a sorted array, as a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_at_most(bounds: Column, x: Column) -> Column:
    """Place (from 0) of the last of the ascending bounds that is at most x; -1 if none is."""
    steps = F.ceil(F.log2(F.size(bounds) + F.lit(1))).cast("int")
    # of places low and on; each step halves what is left, from the largest power of two down
    widths = F.transform(F.sequence(steps, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    step = lambda low, w: F.when((low + w < F.size(bounds)) & (F.get(bounds, low + w) <= x), low + w).otherwise(low)
    return F.aggregate(widths, F.lit(-1), step)

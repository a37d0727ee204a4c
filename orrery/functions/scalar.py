"""Column expressions (PRJ*): none leaves whole-stage code generation."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def truncated_mean(total: str, count: str) -> Column:
    """Integer mean that passes through single precision before it is a bigint again."""
    return F.expr(f"CAST(CAST(({total}) div ({count}) AS FLOAT) AS BIGINT)")


def _bigints(xs: list[int]) -> Column:
    """A constant array that is one node of the plan, however long."""
    return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")


def nearest(value: Column, centres: list[int]) -> Column:
    """The centre with the least absolute distance; the smaller centre wins ties.

    The centres are sorted, and twice a value is sought among the sums of neighbours, first among every so many of them, then
    between two of these: the work for a value goes with the root of their number, and the plan doesn't grow with it.
    """
    sorted_ = sorted(set(centres))
    if len(sorted_) == 1:
        return F.when(value.isNotNull(), F.lit(sorted_[0]).cast("bigint"))
    sums = [a + b for a, b in zip(sorted_, sorted_[1:], strict=False)]
    width = isqrt(len(sums) - 1) + 1 if len(sums) > 1 else 1
    below = lambda a: F.size(F.filter(a, lambda x: x < value * 2))
    block = below(_bigints(sums[::width]))
    within = below(F.slice(_bigints(sums), (block - 1) * width + 1, width))
    at = F.when(block == 0, F.lit(0)).otherwise((block - 1) * width + within)
    return F.when(value.isNotNull(), F.element_at(_bigints(sorted_), at + 1))

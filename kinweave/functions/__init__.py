"""Column expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Gains and weights are rounded before they are compared, so ties don't depend on the order of sums.
GAIN_DIGITS, DISTANCE_DIGITS = 12, 9


def shared_neighbours(a: Column, b: Column) -> Column:
    """The number of values in both arrays."""
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared values over all values of two arrays without repeats; null if both are empty."""
    n = shared_neighbours(a, b)
    return n / F.nullif(F.size(a) + F.size(b) - n, F.lit(0))


def pairs_of(n: Column) -> Column:
    """How many unordered pairs n things make."""
    return n * (n - 1) / 2

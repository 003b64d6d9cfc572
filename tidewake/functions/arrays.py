"""Reductions of arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(c: Column, i: int) -> Column:
    """Element i, from the end if negative; null if there is none."""
    return F.try_element_at(c, F.lit(i if i < 0 else i + 1))


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, v: s + v)


def mean(c: Column) -> Column:
    """0 for an empty array."""
    return F.when(F.size(c) > 0, total(c) / F.size(c)).otherwise(0.0)


def median(c: Column, default: float = 0.0) -> Column:
    s = F.sort_array(F.array_compact(c))  # nulls count as the last ones: there is nothing at their places
    n = F.size(c)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2).otherwise(default)


def pstdev(c: Column) -> Column:
    """Of the population; 0 for less than two values."""
    start = F.struct(F.lit(0.0).alias("s"), mean(c).alias("m"))  # the mean is taken once: in the function it would be for each element
    squares = F.aggregate(c, start, lambda a, v: F.struct((a["s"] + (v - a["m"]) * (v - a["m"])).alias("s"), a["m"].alias("m")), lambda a: a["s"])
    return F.when(F.size(c) > 1, F.sqrt(squares / F.size(c))).otherwise(0.0)


def ratio(c: Column) -> Column:
    """Share of true elements."""
    return F.size(F.filter(c, lambda v: v)) / F.size(c)


def displacement(x: str, y: str) -> Column:
    """From the first to the last point."""
    return F.hypot(at(F.col(x), -1) - at(F.col(x), 0), at(F.col(y), -1) - at(F.col(y), 0))

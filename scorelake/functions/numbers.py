"""Small numeric column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    """Half-up rounding by floor, the same in every engine."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / F.lit(k)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) where f names x more than once: x is computed once and does not multiply the plan."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where bottom is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom)


def exact_mean(x: Column) -> Column:
    """The mean of a double column whose sum is made of decimals of 9 digits, so that it does not depend on the order of the
    rows; values that are no such decimals, such as NaN, are averaged as they are."""
    part = x.try_cast("decimal(28,9)")
    return F.when(F.count(part) == F.count(x), F.sum(part).cast("double") / F.count(part)).otherwise(F.avg(x))

"""Exact aggregate expressions shared by the marts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(num: Column | str, den: Column | str, digits: int) -> Column:
    """num / den rounded half-up at ``digits`` in whole-number arithmetic; null when the denominator is 0.

    ``num`` and ``den`` are whole numbers, num >= 0, so no binary rounding can move a tie.
    """
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    n, d = num.cast("decimal(28,0)"), den.cast("decimal(18,0)")
    scale = 10**digits
    whole = F.call_function("div", n * F.lit(2 * scale) + d, d * F.lit(2))
    return F.when(den != 0, whole.cast("double") / F.lit(float(scale)))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def wins(rank: str = "rank") -> Column:
    return count_if(F.col(rank) == 1)


def podiums(rank: str = "rank") -> Column:
    return count_if(F.col(rank) <= 3)

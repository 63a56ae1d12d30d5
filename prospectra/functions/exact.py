"""Means that don't depend on the order of rows, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "decimal(38,18)"


def mean(name: str) -> Column:
    """Mean of numbers by their decimal digits, rounded once to 18 places; the plain mean if one has other digits (or is
    not finite), or if their sum passes 10**20."""
    x = F.col(name)
    digits = x.try_cast(DIGITS)
    same = digits.isNotNull() & ((F.abs(x) >= 0.01) | (digits.cast("double") == x.cast("double")))  # from 0.01 on, 17 digits fit
    whole = F.count_if(same) == F.count(x)
    return F.coalesce(F.when(whole, (F.try_sum(digits).try_cast(DIGITS) / F.count(x)).cast("double")), F.avg(x))

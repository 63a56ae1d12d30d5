"""Preparation of feature columns (arrays of numbers): imputation, removal of constant columns, scaling. fit reads the training rows, transform any others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import group_medians


def cells(rows: DataFrame, features: str, key: str = "id") -> DataFrame:
    """(i, x, key): one row a component, NaN as null."""
    out = rows.select(F.col(key).alias("__id"), F.posexplode(features).alias("i", "x"))
    return out.select("i", F.when(~F.isnan(F.col("x").cast("double")), F.col("x").cast("double")).alias("x"), F.col("__id").alias("id"))


def _values(table: DataFrame, value: str, n: int, missing: float) -> list[float]:
    """A small table (i, value), one row a feature, as a list."""
    got = {r["i"]: r[value] for r in table.collect()}
    return [missing if got.get(i) is None else float(got[i]) for i in range(n)]


def width(rows: DataFrame, features: str) -> int:
    return rows.agg(F.max(F.size(features))).first()[0] or 0


class Impute:
    """Missing components (null or NaN): the training column's median for continuous features, 0 for binary ones."""

    def __init__(self, kind: str = "continuous"):
        if kind not in ("continuous", "binary"):
            raise ValueError("kind must be 'continuous' or 'binary'")
        self.kind, self.fill = kind, []

    def fit(self, rows: DataFrame, features: str = "features", key: str = "id") -> Impute:
        n = width(rows, features)
        self.fill = [0.0] * n if self.kind == "binary" else _values(group_medians(cells(rows, features, key), "i", "x", "id"), "median", n, 0.0)
        return self

    def transform(self, rows: DataFrame, features: str = "features") -> DataFrame:
        fill = F.array(*map(F.lit, self.fill))
        one = lambda x, i: F.coalesce(F.when(~F.isnan(x.cast("double")), x.cast("double")), F.get(fill, i))
        return rows.withColumn(features, F.transform(features, one))


class VarianceMask:
    """Keeps the columns whose population variance in the training rows is above 1e-10; the same columns at prediction."""

    LEAST = 1e-10

    def __init__(self) -> None:
        self.kept: list[int] = []

    def fit(self, rows: DataFrame, features: str = "features", key: str = "id") -> VarianceMask:
        found = cells(rows, features, key).groupBy("i").agg(F.var_pop("x").alias("v")).collect()  # one row a feature
        self.kept = sorted(r["i"] for r in found if (r["v"] or 0.0) > self.LEAST)
        return self

    def transform(self, rows: DataFrame, features: str = "features") -> DataFrame:
        keep = F.array(*map(F.lit, self.kept)).cast("array<int>")
        return rows.withColumn(features, F.transform(keep, lambda i: F.get(F.col(features), i)))


class Scale:
    """Columns less the training mean, over the training deviation (population; 1 for constant columns)."""

    def __init__(self) -> None:
        self.mean: list[float] = []
        self.std: list[float] = []

    def fit(self, rows: DataFrame, features: str = "features", key: str = "id") -> Scale:
        n = width(rows, features)
        sums = cells(rows, features, key).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
        self.mean = _values(sums, "m", n, 0.0)
        self.std = [x if x > 0 else 1.0 for x in _values(sums, "s", n, 1.0)]
        return self

    def transform(self, rows: DataFrame, features: str = "features") -> DataFrame:
        mean, std = F.array(*map(F.lit, self.mean)), F.array(*map(F.lit, self.std))
        return rows.withColumn(features, F.transform(features, lambda x, i: (x.cast("double") - F.get(mean, i)) / F.get(std, i)))


def leverage(x: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Squared length of L^-1 x for each row, L being the lower triangle of the training rows' products."""
    return np.square(np.linalg.solve(lower, np.asarray(x, float).T)).sum(0)



"""Similarity and nearest neighbours: Tanimoto of bit sets, as packed words or index arrays, and cosine of vectors.

Searches take a stated set of queries against all rows in blocks: a task holds a block of each and keeps the best k of every
query; the blocks' answers are merged by a second top-k. Nothing makes a row for each pair.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship

QUERIES, ROWS = 4096, 8192
WORD = 32


def positive_bits(vector: str | Column) -> Column:
    """0 or 1 for each component: whether it is positive."""
    return F.transform(vector, lambda x: F.when(x > 0, 1).otherwise(0))


def pack(bits: str | Column) -> Column:
    """An array of 0 and 1 as words of WORD bits, the first bit highest; the last word is filled with 0."""
    b = F.col(bits) if isinstance(bits, str) else bits
    words = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(b) / WORD) - 1, F.lit(0)).cast("int"))
    bit = lambda w, j: F.coalesce(F.get(b, w * WORD + j), F.lit(0)).cast("bigint")
    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(WORD - 1)), F.lit(0).cast("bigint"), lambda a, j: a * 2 + bit(w, j))
    return F.when(F.size(b) > 0, F.transform(words, word)).otherwise(F.array().cast("array<bigint>"))


def unpack(words: str, n: Column | int) -> Column:
    """The first n bits of packed words."""
    count = F.lit(n) if isinstance(n, int) else n
    place = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))
    bit = lambda i: F.floor(F.get(F.col(words), F.floor(i / WORD).cast("int")) / F.pow(F.lit(2.0), WORD - 1 - i % WORD)) % 2
    return F.when(count > 0, F.transform(place, lambda i: bit(i).cast("int"))).otherwise(F.array().cast("array<int>"))


def ones(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda a, x: a + F.bit_count(x))


def tanimoto(a: Column, b: Column) -> Column:
    """Of packed words; 1 for two empty sets."""
    both = ones(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    either = ones(a) + ones(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def dice(a: Column, b: Column) -> Column:
    """Of packed words; 1 for two empty sets."""
    both = ones(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    return F.when(ones(a) + ones(b) == 0, 1.0).otherwise(2 * both / (ones(a) + ones(b)))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _similar(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    if metric == "tanimoto":
        both = x @ y.T
        either = x.sum(1)[:, None] + y.sum(1)[None, :] - both
        return np.where(either > 0, both / np.maximum(either, 1), 1.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T, nan=-1.0)


def nearest(queries: DataFrame, rows: DataFrame, k: int, metric: str = "tanimoto", vector: str = "vector", key: str = "id", others: bool = True) -> DataFrame:
    """(key, neighbour, similarity, place 1..k) for each query: its most similar rows, ties to the smaller key.

    vector: an array of numbers; for 'tanimoto' of 0 and 1. others: a row with the query's own key is no neighbour.
    """
    if metric not in ("tanimoto", "cosine"):
        raise ValueError("metric must be 'tanimoto' or 'cosine'")
    if k < 1:
        raise ValueError("k must be positive")
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    qs, rs = (max(1, -(-df.count() // each)) for df, each in ((queries, QUERIES), (rows, ROWS)))
    part = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = queries.select(F.col(key).alias("k"), F.col(vector).alias("v"), part(qs).alias("q"), every(rs).alias("r"), F.lit(True).alias("asks"))
    both = both.unionByName(rows.select(F.col(key).alias("k"), F.col(vector).alias("v"), every(qs).alias("q"), part(rs).alias("r"), F.lit(False).alias("asks")))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        q, r = group[group["asks"]], group[~group["asks"]].sort_values("k", kind="stable")
        out = []
        if len(q) and len(r):
            y = np.stack([np.asarray(v, float) for v in r["v"]])
            keys = r["k"].to_numpy()
            for at in range(0, len(q), 256):
                some = q.iloc[at : at + 256]
                s = _similar(np.stack([np.asarray(v, float) for v in some["v"]]), y, metric)
                s = np.round(s, 12)  # sums in another order are ties all the same
                for name, line in zip(some["k"], s, strict=True):
                    best = np.argsort(-line, kind="stable")[: k + 1]
                    best = best[keys[best] != name][:k] if others else best[:k]
                    out += [(name, keys[i], float(line[i])) for i in best]
        return pd.DataFrame(out, columns=["key", "neighbour", "similarity"])

    found = both.groupBy("q", "r").applyInPandas(search, f"key {kind}, neighbour {kind}, similarity double")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour"))  # k rows a block of each query
    return found.withColumn("place", place).where(F.col("place") <= k).withColumnRenamed("key", key)


def max_similarity(queries: DataFrame, rows: DataFrame, metric: str = "tanimoto", **names: str) -> DataFrame:
    """(key, similarity): each query's largest similarity to another row."""
    return nearest(queries, rows, 1, metric, **names).drop("neighbour", "place")


def local_residuals(queries: DataFrame, rows: DataFrame, residual: str, k: int, key: str = "id", **how: str) -> DataFrame:
    """(key, local_residual): the mean residual of each query's k nearest rows."""
    near = nearest(queries, rows, k, key=key, **how)
    known = rows.select(F.col(key).alias("neighbour"), F.col(residual).alias("__r"))
    return near.join(known, "neighbour").groupBy(key).agg(F.avg("__r").alias("local_residual"))


def neighbour_features(queries: DataFrame, rows: DataFrame, residual: str, k: int, key: str = "id", **how: str) -> DataFrame:
    """Of each query's k nearest rows: largest, smallest and mean similarity; mean, median, deviation and 0.9 quantile of the residual."""
    near = nearest(queries, rows, k, key=key, **how)
    known = rows.select(F.col(key).alias("neighbour"), F.col(residual).alias("__r"))
    s = near.join(known, "neighbour").groupBy(key).agg(  # groups of k rows
        F.max("similarity").alias("similarity_max"), F.min("similarity").alias("similarity_min"), F.avg("similarity").alias("similarity_mean"),
        F.avg("__r").alias("residual_mean"), F.percentile("__r", F.lit(0.5)).alias("residual_median"), F.stddev_pop("__r").alias("residual_std"), F.percentile("__r", F.lit(0.9)).alias("residual_q90"),
    )
    return s


def tanimoto_kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All similarities of two small sets of 0/1 or count rows; 1 for two empty ones."""
    return _similar(np.asarray(x, float), np.asarray(y, float), "tanimoto")



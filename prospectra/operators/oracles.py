"""Oracles: what measures candidates. An oracle takes ids with their places and gives them back with values, in order."""

from __future__ import annotations

import importlib.util
import inspect
import os
import sys
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, OracleError
from ..ship import ship


class Oracle:
    """measure(ids, target) gives (place, id, value) for every row of ids (place, id); known() the ids it can measure, or None for any."""

    def values(self, ids: DataFrame) -> DataFrame:
        raise NotImplementedError

    def known(self) -> DataFrame | None:
        return None

    def measure(self, ids: DataFrame) -> DataFrame:
        """Values in the order of places; an id without a value is an error."""
        got = ids.select("place", "id").join(self.values(ids.select("id")).select("id", "value"), "id", "left")
        bad = got.where(F.col("value").isNull() | F.isnan(F.col("value").cast("double")))
        missing = [r["id"] for r in bad.select("id").limit(5).collect()]  # examples
        if missing:
            raise OracleError(f"no value for some ids, e.g. {', '.join(map(str, missing))}")
        return got.select("place", "id", "value").orderBy("place")


class TableOracle(Oracle):
    """Looks values up in a table; of repeated ids the first by `order` counts, rows without a value are unknown."""

    def __init__(self, table: DataFrame, target: str = "target", key: str = "id", order: str | None = None):
        rows = table.select(F.col(key).alias("id"), F.col(target).try_cast("double").alias("value"), *([F.col(order).alias("__o")] if order else []))
        rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
        first = F.min_by("value", "__o") if order else F.min("value")
        self.table = rows.groupBy("id").agg(first.alias("value"))

    def values(self, ids: DataFrame) -> DataFrame:
        return self.table.join(ids.distinct(), "id", "left_semi")

    def known(self) -> DataFrame:
        return self.table.select("id")


class FunctionOracle(Oracle):
    """A function of a list of ids that gives a data frame with the ids and one more column, or a dict, or as many values.

    spec: the function, or 'path/module.py:function'. It runs on executors, on batches of ids.
    """

    NAMES = ("id", "ID", "Id", "compound_id")

    def __init__(self, spec: str | Callable, value: str | None = None):
        self.function = load(spec) if isinstance(spec, str) else spec
        if len(inspect.signature(self.function).parameters) != 1:
            raise ConfigError("the function must take one parameter, the list of ids")
        self.value = value

    def values(self, ids: DataFrame) -> DataFrame:
        ship(ids.sparkSession)
        function, value, names = self.function, self.value, self.NAMES
        kind = ids.schema["id"].dataType.simpleString()

        def run(batches):
            for batch in batches:
                got = function(batch["id"].tolist())
                if isinstance(got, dict):
                    got = pd.DataFrame({"id": list(got), "value": list(got.values())})
                elif not isinstance(got, pd.DataFrame):
                    got = pd.DataFrame({"id": batch["id"], "value": list(got)})
                key = next((c for c in names if c in got.columns), None)
                if key is None:
                    raise OracleError(f"the result has no id column: {', '.join(map(str, got.columns))}")
                rest = [c for c in got.columns if c != key]
                column = value or (rest[0] if len(rest) == 1 else "value")
                yield pd.DataFrame({"id": got[key], "value": got[column].astype(float)})

        return ids.distinct().mapInPandas(run, f"id {kind}, value double")


def by_value(function: Callable) -> Callable:
    """The function with its module's globals, so that it travels to executors that lack the file."""
    from pyspark.cloudpickle import register_pickle_by_value

    register_pickle_by_value(inspect.getmodule(function))
    return function


def load(spec: str) -> Callable:
    """The function named by 'path/module.py:function'."""
    path, _, name = spec.rpartition(":")
    if not path.endswith(".py") or not name:
        raise ConfigError(f"{spec!r} is not of the form module.py:function")
    if not os.path.exists(path):
        raise ConfigError(f"no file {path}")
    found = importlib.util.spec_from_file_location(os.path.splitext(os.path.basename(path))[0], path)
    module = importlib.util.module_from_spec(found)
    sys.modules[found.name] = module
    found.loader.exec_module(module)
    if not callable(getattr(module, name, None)):
        raise ConfigError(f"{path} has no function {name}")
    return by_value(getattr(module, name))


class SimilarityOracle(Oracle):
    """Similarity of packed bits to a reference's ('tanimoto' or 'dice')."""

    def __init__(self, rows: DataFrame, words: str, reference: list[int], metric: str = "tanimoto", key: str = "id"):
        from . import neighbours

        if metric not in ("tanimoto", "dice"):
            raise ConfigError("metric must be 'tanimoto' or 'dice'")
        one: Callable[[Column, Column], Column] = getattr(neighbours, metric)
        self.table = rows.select(F.col(key).alias("id"), one(F.col(words), F.array(*map(F.lit, reference))).alias("value"))

    def values(self, ids: DataFrame) -> DataFrame:
        return self.table.join(ids.distinct(), "id", "left_semi")

    def known(self) -> DataFrame:
        return self.table.select("id")


def resolve(spec: object, pool: DataFrame, target: str) -> tuple[Oracle, str]:
    """An oracle and the mode it makes: 'benchmark' where a table holds the truth, else 'run'.

    None: the pool's own targets; a DataFrame; a path to a CSV or Parquet table; 'module.py:function'; a function; an Oracle.
    """
    if spec is None:
        return TableOracle(pool, target), "benchmark"
    if isinstance(spec, Oracle):
        return spec, "benchmark" if isinstance(spec, TableOracle) else "run"
    if isinstance(spec, DataFrame):
        return TableOracle(spec, target), "benchmark"
    if callable(spec):
        return FunctionOracle(spec), "run"
    if isinstance(spec, str) and ".py:" in spec:
        return FunctionOracle(spec), "run"
    if isinstance(spec, str):
        spark = pool.sparkSession
        table = spark.read.parquet(spec) if spec.rstrip("/").endswith(".parquet") else spark.read.option("header", True).option("inferSchema", True).csv(spec)
        key = next((c for c in ("id", "ID") if c in table.columns), None)
        if key is None:
            raise OracleError(f"{spec} has no id column")
        return TableOracle(table, target, key), "benchmark"
    raise ConfigError(f"no oracle can be made of {type(spec).__name__}")


def reconcile(pool: DataFrame, oracle: Oracle) -> tuple[DataFrame, DataFrame | None]:
    """The pool's rows that the oracle knows, and the others (None: it knows any)."""
    known = oracle.known()
    if known is None:
        return pool, None
    known = known.hint("merge")  # as many rows as the pool, whatever size its files suggest
    return pool.join(known, "id", "left_semi"), pool.join(known, "id", "left_anti")


def backfill(rows: DataFrame, oracle: TableOracle, target: str = "target") -> DataFrame:
    """Rows with the oracle's value where the target is null."""
    return rows.join(oracle.table, "id", "left").withColumn(target, F.coalesce(F.col(target), F.col("value"))).drop("value")

"""Guards: one aggregate over the table each, and an error that says how many rows are at fault."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..errors import AcquisitionError, InputError, LearnerError, PruningError
from .pool import STATUSES

MASTER = {"status": "string", "labeled_cycle": "bigint", "selected_cycle": "bigint", "pruned_cycle": "bigint"}


def finite(*names: str) -> Column:
    """Whether all the columns are neither null nor NaN nor infinite."""
    one = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return reduce(and_, map(one, names))


def any_null(*names: str) -> Column:
    """Whether one of the columns is null."""
    return reduce(or_, (F.col(c).isNull() for c in names))


def counts(rows: DataFrame, faults: dict[str, Column]) -> dict[str, int]:
    """How many rows have each fault; one pass."""
    got = rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in faults.items())).first()
    return {n: got[n] or 0 for n in faults}


def _refuse(kind: type, what: str, found: dict[str, int]) -> None:
    bad = {k: v for k, v in found.items() if v}
    if bad:
        raise kind(f"{what}: " + ", ".join(f"{v} rows with {k}" for k, v in bad.items()))


def predictions(rows: DataFrame) -> DataFrame:
    """The rows, if no prediction is null or NaN and no uncertainty null, NaN or infinite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    faults = {"a null or NaN prediction": bad("prediction")}
    if "uncertainty" in rows.columns:
        faults["a null or NaN uncertainty"] = bad("uncertainty")
        faults["an infinite uncertainty"] = F.abs(F.col("uncertainty")) == float("inf")
    _refuse(LearnerError, "invalid predictions", counts(rows, faults))
    return rows


def uncertainty(rows: DataFrame) -> DataFrame:
    """The rows, if both columns are there and no uncertainty is negative or not finite."""
    for c in ("prediction", "uncertainty"):
        if c not in rows.columns:
            raise AcquisitionError(f"column {c} is missing; the columns are {', '.join(rows.columns)}")
    _refuse(AcquisitionError, "invalid uncertainty", counts(rows, {"a negative value": F.col("uncertainty") < 0, "a value that isn't finite": ~finite("uncertainty")}))
    return rows


def target_type(rows: DataFrame, target: str) -> None:
    """Targets are numbers; truth values are refused."""
    if target not in rows.columns:
        raise InputError(f"column {target} is missing; the columns are {', '.join(rows.columns)}")
    kind = rows.schema[target].dataType
    if isinstance(kind, BooleanType) or not isinstance(kind, NumericType):
        raise InputError(f"column {target} is {kind.simpleString()}, not a number")


def strict_number(c: str) -> Column:
    """A string column as double; a text that is no number stops the query."""
    return F.when(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), F.raise_error(F.concat(F.lit(f"{c} is no number: "), F.col(c)))).otherwise(F.col(c).try_cast("double"))


def active(rows: DataFrame, c: str = "activity") -> Column:
    """Whether the label, a number, is 1 as an integer."""
    if not isinstance(rows.schema[c].dataType, NumericType):
        raise InputError(f"column {c} is {rows.schema[c].dataType.simpleString()}, not a number")
    return F.col(c).cast("bigint") == 1


def master_faults(master: DataFrame, target: str = "target") -> dict[str, int]:
    """Faults of a table of candidate states and how many rows have each; columns and types are checked first."""
    missing = [c for c in ("id", *MASTER, target) if c not in master.columns]
    if missing:
        raise InputError(f"columns are missing: {', '.join(missing)}")
    kinds = dict(master.dtypes)
    wrong = [f"{c} is {kinds[c]}, not {k}" for c, k in MASTER.items() if kinds[c] != k]
    if wrong:
        raise InputError("; ".join(wrong))
    found = counts(master, {
        "null_id": F.col("id").isNull(),
        "unknown_status": F.col("status").isNull() | ~F.col("status").isin(*STATUSES),
        "labeled_without_cycle": (F.col("status") == "labeled") & F.col("labeled_cycle").isNull(),
        "pruned_without_cycle": (F.col("status") == "pruned") & F.col("pruned_cycle").isNull(),
        "unlabeled_with_target": (F.col("status") == "unlabeled") & F.col(target).isNotNull(),
    })
    again = master.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))).first()[0]
    return found | {"repeated_id": again}


def master(rows: DataFrame, target: str = "target") -> DataFrame:
    """The rows, if they are a valid table of states."""
    found = {k: v for k, v in master_faults(rows, target).items() if v}
    if found:
        raise InputError("invalid states: " + ", ".join(f"{k} {v}" for k, v in found.items()), found)
    return rows


def unique(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows, if no key occurs twice."""
    again = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*")).first()[0]
    if again:
        raise InputError(f"{again} keys ({', '.join(keys)}) occur more than once")
    return rows


def pruning(fraction: float, direction: str, **others: object) -> None:
    if others:
        raise PruningError(f"unknown settings: {', '.join(others)}")
    if not 0 <= fraction <= 0.9:
        raise PruningError(f"the fraction must lie in [0, 0.9], not {fraction}")
    if direction not in ("higher", "lower"):
        raise PruningError(f"direction must be 'higher' or 'lower', not {direction!r}")

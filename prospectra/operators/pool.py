"""The pool of candidates and its states: unlabeled, labeled, pruned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PruningError
from .order import ranked

STATUSES = ("unlabeled", "labeled", "pruned")


def master_table(pool: DataFrame) -> DataFrame:
    """Every candidate unlabeled, with empty cycles and target."""
    empty = {c: F.lit(None).cast("bigint") for c in ("labeled_cycle", "selected_cycle", "pruned_cycle")}
    return pool.select("id", F.lit("unlabeled").alias("status"), *(v.alias(k) for k, v in empty.items()), F.lit(None).cast("double").alias("target"))


def with_status(master: DataFrame, status: str, columns: list[str] | None = None) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}; one of {', '.join(STATUSES)}")
    return master.where(F.col("status") == status).select(*(columns or master.columns))


def label(master: DataFrame, measured: DataFrame, cycle: int) -> DataFrame:
    """Marks measured candidates (id, value): a first selection's cycle stays, a new value replaces an old one."""
    new = measured.select("id", F.col("value").alias("__value"), F.lit(True).alias("__hit"))
    hit = F.col("__hit").isNotNull()
    return master.join(new, "id", "left").select(
        "id",
        F.when(hit, F.lit("labeled")).otherwise(F.col("status")).alias("status"),
        F.when(hit, F.lit(cycle).cast("bigint")).otherwise(F.col("labeled_cycle")).alias("labeled_cycle"),
        F.when(hit & F.col("selected_cycle").isNull(), F.lit(cycle).cast("bigint")).otherwise(F.col("selected_cycle")).alias("selected_cycle"),
        "pruned_cycle",
        F.coalesce("__value", "target").alias("target"),
    )


def prune(master: DataFrame, ids: DataFrame, cycle: int) -> DataFrame:
    gone = ids.select("id", F.lit(True).alias("__gone"))
    return master.join(gone, "id", "left").select(
        "id",
        F.when(F.col("__gone"), F.lit("pruned")).otherwise(F.col("status")).alias("status"),
        "labeled_cycle", "selected_cycle",
        F.when(F.col("__gone"), F.lit(cycle).cast("bigint")).otherwise(F.col("pruned_cycle")).alias("pruned_cycle"),
        "target",
    )


def split_duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Adds is_valid: false for all rows of a key that occurs more than once."""
    return rows.withColumn("is_valid", F.count("*").over(Window.partitionBy(key)) == 1)


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__i = 1").drop("__i")


def first_row(rows: DataFrame, key: str, place: str) -> DataFrame:
    """The row of each key that came first by place, whatever its other columns are; one aggregate, no window."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), place).alias("__row")).select(key, "__row.*")


def mapped(value: str, names: dict, default: object = None, strict: bool = False) -> Column:
    """The value's entry in names; others give the default, or stop the query if strict."""
    known = F.lit(None)
    for k, v in names.items():
        known = F.when(F.col(value) == F.lit(k), F.lit(v)).otherwise(known)
    inside = F.col(value).isin(*names)
    if strict:
        return F.when(inside, known).otherwise(F.raise_error(F.concat(F.lit(f"{value} has no entry for "), F.coalesce(F.col(value).cast("string"), F.lit("null")))))
    return F.when(inside, known).otherwise(F.lit(default))


def keep_count(n: int, fraction: float) -> int:
    """How many of n rows score pruning keeps: all but int(n * fraction), at least one."""
    return max(1, n - int(n * fraction)) if n else 0


def score_ranks(predictions: DataFrame, direction: str = "higher") -> DataFrame:
    """Adds position, best first, smaller ids first among ties, and total; no limit that grows with the table."""
    score = (1 if direction == "higher" else -1) * F.col("prediction")
    return ranked(predictions, score, "id", descending=True, ties=False)


def keep_best(predictions: DataFrame, fraction: float, direction: str = "higher", **others: object) -> tuple[DataFrame, int]:
    """Score pruning: without the worst int(n * fraction) rows, at least one kept, smaller ids kept among ties."""
    from . import checks

    checks.pruning(fraction, direction, **others)
    keep = keep_count(predictions.count(), fraction)
    return score_ranks(predictions, direction).where(F.col("position") <= keep).drop("position", "total"), keep


def prune_stats(predictions: DataFrame, fraction: float, direction: str = "higher") -> DataFrame:
    """One row: rows removed, their share, the score of the last row kept, and smallest, largest and mean prediction kept."""
    from . import checks

    checks.pruning(fraction, direction)
    keep = keep_count(predictions.count(), fraction)
    kept = F.col("position") <= keep
    r = lambda c: F.round(c, 6)
    return score_ranks(predictions, direction).agg(
        F.count_if(kept).alias("kept"), F.count_if(~kept).alias("removed"), r(F.count_if(~kept) / F.count("*")).alias("removed_share"),
        r(F.max(F.when(F.col("position") == keep, F.col("prediction")))).alias("threshold"),
        r(F.min(F.when(kept, F.col("prediction")))).alias("kept_min"), r(F.max(F.when(kept, F.col("prediction")))).alias("kept_max"), r(F.avg(F.when(kept, F.col("prediction")))).alias("kept_mean"),
    )


class Pruner:
    """What takes candidates out of a pool: prune() gives the rows to keep. Input checks are done for it."""

    name = "none"

    def prune(self, predictions: DataFrame) -> DataFrame:
        return predictions

    def __call__(self, predictions: DataFrame) -> DataFrame:
        for c in ("id", "prediction"):
            if c not in predictions.columns:
                raise PruningError(f"column {c} is missing; the columns are {', '.join(predictions.columns)}")
        return self.prune(predictions)


class ScorePruner(Pruner):
    name = "score"

    def __init__(self, fraction: float = 0.1, direction: str = "higher", **others: object):
        from . import checks

        checks.pruning(fraction, direction, **others)
        self.fraction, self.direction = fraction, direction

    def prune(self, predictions: DataFrame) -> DataFrame:
        return keep_best(predictions, self.fraction, self.direction)[0]


PRUNERS = {p.name: p for p in (Pruner, ScorePruner)}

"""Calibration of predicted uncertainty: columns id, target (truth), prediction, uncertainty."""

from __future__ import annotations

from functools import reduce
from operator import add
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normal
from . import evaluation, order
from .order import ranked

LEVELS = [0.05 + 0.9 * i / 19 for i in range(20)]
FRACTIONS = [0.95 * i / 49 for i in range(50)]
REMOVED = [0.9 * i / 18 for i in range(19)]


def z_of(level: float) -> float:
    """Half-width of the central interval of a normal distribution, in standard deviations."""
    return NormalDist().inv_cdf((1 + level) / 2)


def residuals(rows: DataFrame) -> DataFrame:
    return rows.withColumn("residual", F.col("target") - F.col("prediction")).withColumn("error", F.abs("residual"))


def trapezoid(y: list[Column], x: list[float]) -> Column:
    return reduce(add, ((b + a) * ((q - p) / 2) for a, b, p, q in zip(y, y[1:], x, x[1:])))


def curve(row: DataFrame, points: list[dict[str, Column]]) -> DataFrame:
    """One row a point, from one row of aggregates."""
    return row.select(F.inline(F.array(*(F.struct(*(c.alias(n) for n, c in p.items())) for p in points))))


def nll(rows: DataFrame) -> DataFrame:
    return residuals(rows).agg(F.round(F.expr("avg(0.5 * ln(2 * pi() * uncertainty * uncertainty) + residual * residual / (2 * uncertainty * uncertainty))"), 6).alias("nll"))


def tiles(rows: DataFrame, value: str, n: int) -> DataFrame:
    """Adds tile 0..n-1 by rank of value; the first total % n tiles have one row more."""
    rows = ranked(rows, value, "id", ties=False)
    small, extra = F.floor(F.col("total") / n), F.col("total") % n
    at = F.col("position") - 1
    return rows.withColumn("tile", F.when(at < extra * (small + 1), F.floor(at / (small + 1))).otherwise(extra + F.floor((at - extra * (small + 1)) / F.greatest(small, F.lit(1)))).cast("int"))


def tile_scales(rows: DataFrame, n: int = 10) -> DataFrame:
    """For each tile of uncertainty: rows, root mean squared error, root mean variance, and which of the two is larger."""
    bins = tiles(residuals(rows), "uncertainty", n).groupBy("tile").agg(F.count("*").alias("rows"), F.sqrt(F.avg(F.col("residual") ** 2)).alias("rmse"), F.sqrt(F.avg(F.col("uncertainty") ** 2)).alias("rmv"))
    return bins.withColumn("overconfident", F.col("rmse") > F.col("rmv"))


def ence(rows: DataFrame, n: int = 10) -> DataFrame:
    """Expected normalised calibration error over tiles of uncertainty."""
    return tile_scales(rows, n).where("rows > 1").agg(F.round(F.avg(F.abs(F.col("rmse") - F.col("rmv")) / F.col("rmv")), 6).alias("ence"))


def scale_errors(rows: DataFrame, n: int = 10) -> DataFrame:
    """The tiles' absolute errors weighted by their rows, and the mean of the relative ones."""
    gap = F.abs(F.col("rmse") - F.col("rmv"))
    return tile_scales(rows, n).agg(F.round(F.sum(gap * F.col("rows")) / F.sum("rows"), 6).alias("uce"), F.round(F.avg(gap / F.col("rmv")), 6).alias("ence"))


def tile_errors(rows: DataFrame, n: int = 5) -> DataFrame:
    parts = tiles(residuals(rows), "uncertainty", n)
    means = parts.groupBy("tile").agg(F.count("*").alias("n"), F.round(F.avg("error"), 6).alias("mean_error"))
    middle = order.group_medians(parts.select("tile", "error", "id"), "tile", "error", "id", "median_error")
    return means.join(F.broadcast(middle), "tile").select("tile", "n", "mean_error", F.round("median_error", 6).alias("median_error"))  # n rows


def covered(z: float) -> Column:
    return F.avg((F.col("error") <= z * F.col("uncertainty")).cast("double"))


def coverage(rows: DataFrame, levels: dict[float, float]) -> DataFrame:
    """Share of rows within z uncertainties, for each level's z."""
    return residuals(rows).agg(*(F.round(covered(z), 6).alias(f"coverage_{round(level * 100)}") for level, z in levels.items()))


def coverage_errors(rows: DataFrame, levels: list[float]) -> DataFrame:
    """Empirical less nominal coverage for each level, and the mean and largest of their sizes."""
    found = residuals(rows).agg(*((covered(z_of(p)) - p).alias(f"coverage_error_{round(p * 100)}") for p in levels))
    sizes = [F.abs(F.col(c)) for c in found.columns]
    mean = reduce(add, sizes) / len(sizes)
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns), F.round(mean, 6).alias("mean_error"), F.round(F.greatest(*sizes) if len(sizes) > 1 else sizes[0], 6).alias("max_error"))


def calibration_curve(rows: DataFrame, levels: list[float] = LEVELS) -> DataFrame:
    """(expected, empirical) coverage, one row a level."""
    row = residuals(rows).agg(*(covered(z_of(p)).alias(f"p{i}") for i, p in enumerate(levels)))
    return curve(row, [{"expected": F.round(F.lit(p), 6), "empirical": F.round(f"p{i}", 6)} for i, p in enumerate(levels)])


def miscalibration_area(rows: DataFrame, levels: list[float] = LEVELS) -> DataFrame:
    """Area between the calibration curve and the diagonal."""
    row = residuals(rows).agg(*(F.abs(covered(z_of(p)) - p).alias(f"p{i}") for i, p in enumerate(levels)))
    return row.select(F.round(trapezoid([F.col(f"p{i}") for i in range(len(levels))], levels), 6).alias("miscalibration_area"))


def _retained(rows: DataFrame, by: str, name: str) -> DataFrame:
    """One row: the mean error of the rows left when the share f of largest `by` is taken out, for each f."""
    rows = ranked(rows, by, "id", ties=False)
    total = F.max("total")
    out = []
    for i, f in enumerate(FRACTIONS):
        left = F.greatest(F.lit(1), F.col("total") - F.floor(F.lit(f) * F.col("total")))
        out.append((F.sum(F.when(F.col("position") <= left, F.col("error"))) / F.greatest(F.lit(1), total - F.floor(F.lit(f) * total))).alias(f"{name}{i}"))
    return rows.agg(*out)


def _both(rows: DataFrame) -> DataFrame:
    rows = residuals(rows)
    return _retained(rows, "uncertainty", "model").crossJoin(F.broadcast(_retained(rows, "error", "oracle")))  # one row each


def sparsification(rows: DataFrame) -> DataFrame:
    """fraction taken out, mean error left when the most uncertain go (model) and when the worst go (oracle)."""
    return curve(_both(rows), [{"fraction": F.round(F.lit(f), 6), "model_mae": F.round(f"model{i}", 6), "oracle_mae": F.round(f"oracle{i}", 6)} for i, f in enumerate(FRACTIONS)])


def ause(rows: DataFrame) -> DataFrame:
    """Area between the two curves; null for fewer than ten rows."""
    gaps = [F.col(f"model{i}") - F.col(f"oracle{i}") for i in range(len(FRACTIONS))]
    few = rows.limit(10).count() < 10
    return _both(rows).select((F.lit(None).cast("double") if few else F.round(trapezoid(gaps, FRACTIONS), 6)).alias("ause"))


def _tie_aware(rows: DataFrame, by: str, name: str) -> DataFrame:
    """One row: mean error left, relative to that of all rows; rows of a score that the cut goes through count by their share."""
    rows = ranked(rows, by, "id")
    total = F.col("total")
    out = []
    for i, f in enumerate(REMOVED):
        left = F.greatest(F.lit(1), F.bround(F.lit(1 - f) * total).cast("bigint"))
        weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (left - F.col("rank") + 1) / F.col("ties")))
        out.append((F.sum(weight * F.col("error")) / F.max(left) / F.avg("error")).alias(f"{name}{i}"))
    return rows.agg(*out)


def tie_aware_sparsification(rows: DataFrame) -> DataFrame:
    """fraction taken out and the relative mean errors left, by uncertainty and by the error itself."""
    rows = residuals(rows)
    both = _tie_aware(rows, "uncertainty", "model").crossJoin(F.broadcast(_tie_aware(rows, "error", "oracle")))  # one row each
    return curve(both, [{"fraction": F.round(F.lit(f), 6), "model": F.round(f"model{i}", 6), "oracle": F.round(f"oracle{i}", 6)} for i, f in enumerate(REMOVED)])


def normalized_ause(rows: DataFrame) -> DataFrame:
    rows = residuals(rows)
    both = _tie_aware(rows, "uncertainty", "model").crossJoin(F.broadcast(_tie_aware(rows, "error", "oracle")))  # one row each
    gaps = [F.col(f"model{i}") - F.col(f"oracle{i}") for i in range(len(REMOVED))]
    return both.select(F.round(trapezoid(gaps, REMOVED) / 0.9, 6).alias("normalized_ause"))


def crps(rows: DataFrame) -> DataFrame:
    z = "(residual / uncertainty)"
    return residuals(rows).agg(F.round(F.expr(f"avg(uncertainty * ({z} * (2 * ({normal.cdf(z)}) - 1) + 2 * {normal.pdf(z)} - 0.5641895835477563D))"), 6).alias("crps"))


def order_statistic(rows: DataFrame, value: str, coverage: float) -> DataFrame:
    """One row: the value at place ceil((n + 1) * coverage), at most n."""
    if not 0 < coverage < 1:
        raise ValueError("coverage must lie in (0, 1)")
    place = F.least(F.col("total"), F.ceil((F.col("total") + 1) * coverage))
    return ranked(rows, value, "id", ties=False).where(F.col("position") == place).select(F.col(value).alias("quantile"))


def conformal_quantile(rows: DataFrame, coverage: float) -> DataFrame:
    """Order statistic ceil((n + 1) * coverage), at most n, of error over uncertainty."""
    rows = residuals(rows).withColumn("ratio", F.col("error") / F.col("uncertainty"))
    return order_statistic(rows, "ratio", coverage).select(F.round("quantile", 6).alias("quantile"))


def score_of(lower: Column, upper: Column, alpha: float) -> Column:
    """Width plus 2 / alpha times what the truth lies outside."""
    y = F.col("target")
    return (upper - lower) + 2 / alpha * (F.greatest(lower - y, F.lit(0.0)) + F.greatest(y - upper, F.lit(0.0)))


def interval_score(rows: DataFrame, z: float, alpha: float) -> DataFrame:
    lower, upper = F.col("prediction") - z * F.col("uncertainty"), F.col("prediction") + z * F.col("uncertainty")
    return rows.agg(F.round(F.avg(score_of(lower, upper, alpha)), 6).alias("interval_score"))


def interval_metrics(rows: DataFrame, nominal: float) -> DataFrame:
    """Of intervals lower..upper: coverage and its error, mean and median width, score, share of crossed bounds."""
    lower, upper = F.col("lower"), F.col("upper")
    rows = rows.withColumn("width", upper - lower)
    hit = F.avg(((F.col("target") >= lower) & (F.col("target") <= upper)).cast("double"))
    means = rows.agg(hit.alias("coverage"), (hit - nominal).alias("coverage_error"), F.avg("width").alias("mean_width"), F.avg(score_of(lower, upper, 1 - nominal)).alias("interval_score"), F.avg((lower > upper).cast("double")).alias("crossed"))
    out = means.crossJoin(F.broadcast(order.at_quantiles(rows, "width", "id", {"median_width": 0.5})))  # one row each
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def cqr(calibration: DataFrame, test: DataFrame, coverage: float) -> DataFrame:
    """test with its bounds moved out by the calibration rows' conformal correction, which is never negative; bounds: lower, upper."""
    miss = F.greatest(F.col("lower") - F.col("target"), F.col("target") - F.col("upper"))
    found = order_statistic(calibration.withColumn("miss", miss), "miss", coverage).select(F.greatest(F.lit(0.0), "quantile").alias("correction"), F.col("quantile").alias("raw_correction"))
    return test.crossJoin(F.broadcast(found)).withColumns({"lower": F.col("lower") - F.col("correction"), "upper": F.col("upper") + F.col("correction")})  # one row


def scale(rows: DataFrame) -> DataFrame:
    return residuals(rows).agg(F.round(F.sqrt(F.avg((F.col("residual") / F.col("uncertainty")) ** 2)), 6).alias("scale"))


def bounded_scale(rows: DataFrame, low: float = 0.01, high: float = 100.0) -> DataFrame:
    """The factor in [low, high] that makes the Gaussian likelihood of the residuals largest: that of scale(), cut to the bounds, since the likelihood has one peak."""
    return residuals(rows).agg(F.round(F.greatest(F.lit(low), F.least(F.lit(high), F.sqrt(F.avg((F.col("residual") / F.col("uncertainty")) ** 2)))), 6).alias("scale"))


def summary(rows: DataFrame) -> DataFrame:
    """Mean absolute error, root mean squared error, and the rank correlation of uncertainty and error."""
    rows = residuals(rows)
    means = rows.agg(F.round(F.avg("error"), 6).alias("mae"), F.round(F.sqrt(F.avg(F.col("residual") ** 2)), 6).alias("rmse"))
    return means.crossJoin(F.broadcast(evaluation.spearman(rows, "uncertainty", "error")))  # one row each


def member_spread(rows: DataFrame, members: str = "members") -> DataFrame:
    """Adds mad (median distance from the members' median) and half_iqr of an array of member predictions."""
    def at(array: Column, share: float) -> Column:
        place = (F.size(array) - 1) * F.lit(share)
        low = F.floor(place).cast("int")
        a, b = F.get(array, low), F.get(array, F.ceil(place).cast("int"))
        return a + (b - a) * (place - low)

    out = rows.withColumn("__s", F.sort_array(F.transform(members, lambda x: x.cast("double"))))
    out = out.withColumn("__m", at(F.col("__s"), 0.5))
    out = out.withColumn("__d", F.sort_array(F.transform("__s", lambda x: F.abs(x - F.col("__m")))))
    return out.withColumns({"mad": at(F.col("__d"), 0.5), "half_iqr": (at(F.col("__s"), 0.75) - at(F.col("__s"), 0.25)) / 2}).drop("__s", "__m", "__d")


def jackknife(rows: DataFrame, counts: list[list[float]], members: str = "members", key: str = "id") -> DataFrame:
    """Infinitesimal-jackknife variance of a bagged ensemble, with the correction for finitely many members.

    counts: how often each training row (inner) is in each member's sample (outer); it goes with the tasks and is as large as
    the ensemble's own training samples. Adds raw_variance, corrected_variance and standard_error.
    """
    import numpy as np
    import pandas as pd

    n = np.asarray(counts, float) - 1.0
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            t = np.array([np.asarray(x, float) for x in batch["m"]]).reshape(len(batch), -1)
            c = t - t.mean(1, keepdims=True)
            raw = np.zeros(len(t))
            for at in range(0, n.shape[1], 1024):
                raw += np.square(c @ n[:, at : at + 1024] / len(n)).sum(1)
            fixed = raw - n.shape[1] * t.var(1) / len(n)
            yield pd.DataFrame({"k": batch["k"], "raw_variance": raw, "corrected_variance": fixed, "standard_error": np.sqrt(np.maximum(fixed, 0))})

    out = rows.select(F.col(key).alias("k"), F.col(members).alias("m")).mapInPandas(run, f"k {kind}, raw_variance double, corrected_variance double, standard_error double")
    return out.withColumnRenamed("k", key)


def mid_cdf(reference: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """Adds mid_cdf: the mean of the shares of reference values below, and not above, the row's value."""
    values = reference.select(F.col(value).alias("__v"), F.lit(1).alias("__c")).unionByName(rows.select(F.col(value).alias("__v"), F.lit(0).alias("__c")))
    steps = values.where("__v IS NOT NULL").groupBy("__v").agg(F.sum("__c").alias("__c"))
    sums = order.running(steps, "__v", "__c")
    share = (2 * F.col("__before") + F.col("__c")) / (2 * F.col("__all"))
    return rows.join(sums.select("__v", share.alias("mid_cdf")), rows[value] == F.col("__v"), "left").drop("__v")


def rank_blend(reference: DataFrame, rows: DataFrame, values: list[str], name: str = "rank_blend") -> DataFrame:
    """Adds the mean of the values' mid_cdf."""
    for i, v in enumerate(values):
        rows = mid_cdf(reference, rows, v).withColumnRenamed("mid_cdf", f"__m{i}")
    return rows.withColumn(name, reduce(add, (F.col(f"__m{i}") for i in range(len(values)))) / len(values)).drop(*(f"__m{i}" for i in range(len(values))))


def group_folds(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """Adds fold: groups go whole, the largest first, to the fold that a snake order over sizes gives, so that folds differ by about a group.

    Fold of the group of rank r (from 0, by size, then name): r mod 2 * folds, mirrored in the second half.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("__n"))
    places = ranked(sizes, "__n", group, descending=True, ties=False)
    r = F.pmod(F.col("position") - 1, F.lit(2 * folds))
    places = places.select(group, F.when(r < folds, r).otherwise(2 * folds - 1 - r).cast("int").alias("fold"))
    return rows.join(places, group)


def permutation_importance(rows: DataFrame, groups: dict[str, list[str]], predict, error: Column, seed: int = 0, key: str = "id") -> DataFrame:
    """group, importance: by how much the mean error grows when a group of columns is dealt anew among the rows.

    predict: rows to rows with what error needs. Rows are paired by their places by key and by a counter hash.
    """
    from ..functions import counter

    base = predict(rows).agg(F.avg(error).alias("base"))
    by_key = ranked(rows, F.col(key), key, ties=False).drop("total")
    out = None
    for g, columns in groups.items():
        other = ranked(rows.select(key, *columns), counter.uniform(f"{seed}:{g}", F.col(key)), key, ties=False).select("position", *columns)
        mixed = predict(by_key.drop(*columns).join(other, "position").drop("position"))
        one = mixed.agg(F.avg(error).alias("mixed")).crossJoin(F.broadcast(base)).select(F.lit(g).alias("group"), F.round(F.col("mixed") - F.col("base"), 6).alias("importance"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def decision_gate(metrics: DataFrame, run: str, method: str, value: str, baseline: str, candidate: str, tolerance: float) -> DataFrame:
    """One row: runs, paired improvements of the candidate over the baseline (least, mean), whether all improve, all worsen, and all stay within the tolerance."""
    wide = metrics.where(F.col(method).isin(baseline, candidate)).groupBy(run).pivot(method, [baseline, candidate]).agg(F.first(value))
    gain = F.col(f"`{baseline}`") - F.col(f"`{candidate}`")
    return wide.where(gain.isNotNull()).agg(
        F.count("*").alias("runs"), F.round(F.min(gain), 6).alias("least"), F.round(F.avg(gain), 6).alias("mean"),
        F.bool_and(gain > 0).alias("all_improve"), F.bool_and(gain < 0).alias("all_worsen"), F.bool_and(F.abs(gain) <= tolerance).alias("within"),
    )

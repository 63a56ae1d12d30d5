"""Metrics of a cycle: discovery, enrichment, overlap, ranks, diversity."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import order
from .order import indexed, ranked


def sizes(total: Column, counts: tuple = (10, 100, 1000), shares: tuple = (0.001, 0.01, 0.1)) -> dict[str, Column]:
    out = {str(c): F.least(F.lit(c), total) for c in counts}
    return out | {f"{s * 100:g}_pct".replace(".", "_"): F.greatest(F.lit(1), F.floor(total * s)) for s in shares}


def discovery(pool: DataFrame, selected: DataFrame, target: str = "target") -> DataFrame:
    """Share (%) of the true best k that is selected, for six k: one ranking, one join, conditional sums."""
    rows = ranked(pool, target, "id", descending=True, ties=False).join(selected.select("id", F.lit(1).alias("__hit")), "id", "left")
    k = sizes(F.col("total"))
    return rows.agg(*(F.round(100 * F.sum(F.when(F.col("position") <= v, F.coalesce("__hit", F.lit(0))).otherwise(0)) / F.max(v), 6).alias(f"top_{n}_discovery") for n, v in k.items()))


def enrichment(pool: DataFrame, selected: DataFrame) -> DataFrame:
    """Hit rate of the selection over that of the pool; null without actives or selection."""
    rows = pool.join(selected.select("id", F.lit(1).alias("__hit")), "id", "left")
    a = rows.agg(F.count("*").alias("n"), F.sum("activity").alias("actives"), F.sum("__hit").alias("selected"), F.sum(F.when(F.col("__hit") == 1, F.col("activity"))).alias("hits"))
    return a.select("selected", "hits", F.round(F.expr("try_divide(try_divide(hits, selected), try_divide(actives, n))"), 6).alias("enrichment"), F.round(F.expr("try_divide(hits, selected)"), 6).alias("hit_rate"))


def enrichment_at(pool: DataFrame, score: str, percents: tuple) -> DataFrame:
    """Enrichment factor among the best p percent by score."""
    rows = ranked(pool, score, "id", descending=True, ties=False)
    out = []
    for p in percents:
        n = F.max(F.greatest(F.lit(1), F.floor(F.col("total") * p / 100)))
        hits = F.sum(F.when(F.col("position") <= F.greatest(F.lit(1), F.floor(F.col("total") * p / 100)), F.col("activity")).otherwise(0))
        out.append(F.round(F.max("total") * hits / (F.sum("activity") * n), 6).alias(f"ef_{p:g}".replace(".", "_")))
    return rows.agg(*out)


def as_is(rows: DataFrame) -> DataFrame:
    return rows


def two_ranks(rows: DataFrame, a: str, b: str, descending: bool = False, ties: bool = True, keep: Callable[[DataFrame], DataFrame] = as_is) -> DataFrame:
    """The rows with both columns' places; the second ranking takes the first one's rows, so that nothing is joined back. keep: may store what the passes of a ranking read."""
    both = keep(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()))
    first = ranked(both, a, "id", descending, ties).drop("total").withColumnsRenamed({"position": "position_a", "rank": "rank_a", "ties": "ties_a"})
    return ranked(keep(first), b, "id", descending, ties)


def overlap(rows: DataFrame, a: str = "prediction", b: str = "target", counts: tuple = (100, 1000), shares: tuple = (0.001, 0.01, 0.1)) -> DataFrame:
    """Share (%) of the best k by a that are among the best k by b."""
    both = two_ranks(rows, a, b, descending=True, ties=False)
    k = sizes(F.col("total"), counts, shares)
    return both.agg(*(F.round(100 * F.sum(((F.col("position_a") <= v) & (F.col("position") <= v)).cast("int")) / F.max(v), 6).alias(f"overlap_{n}") for n, v in k.items()))


def spearman(rows: DataFrame, a: str, b: str, name: str = "spearman") -> DataFrame:
    """Correlation of average ranks; null for fewer than two rows or a constant column."""
    both = two_ranks(rows, a, b)
    ra, rb = F.col("rank_a") + (F.col("ties_a") - 1) / 2, F.col("rank") + (F.col("ties") - 1) / 2
    found = F.corr(ra, rb)
    return both.agg(F.round(F.when(~F.isnan(found), found), 6).alias(name))


def selected_percentile(pool: DataFrame, selected: DataFrame, value: str = "target", direction: str = "higher") -> DataFrame:
    """Mean over the selection of the share (%) of the pool that is at most as good."""
    at = (F.col("rank") + F.col("ties") - 1) / F.col("total")
    return ranked(pool, value, "id", descending=direction == "lower").join(selected.select("id"), "id", "left_semi").agg(F.round(100 * F.avg(at), 6).alias("selected_percentile"))


def average_score(rows: DataFrame, value: str = "target") -> DataFrame:
    """Mean value, and how many rows have one."""
    return rows.agg(F.round(F.avg(value), 6).alias("average_score"), F.count(value).alias("n"))


def prediction_stats(rows: DataFrame) -> DataFrame:
    """Rows, and mean, deviation, least, largest and median prediction; without the median for uncertainty. The median comes from exact ranks."""
    r = lambda c, n: F.round(c, 6).alias(n)
    kinds = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    columns = [c for c in ("prediction", "uncertainty") if c in rows.columns]
    means = rows.agg(F.count("*").alias("n"), *(r(f(c), f"{c}_{n}") for c in columns for n, f in kinds.items()))
    middle = order.at_quantiles(rows, "prediction", "id", {"m": 0.5}).select(r(F.col("m"), "prediction_median"))
    return means.crossJoin(F.broadcast(middle))  # one row each


def measured_stats(master: DataFrame, cycle: int, direction: str = "higher") -> DataFrame:
    """Of the batch measured in a cycle: mean, deviation, least, largest, best; and the best of all measured so far."""
    best = F.max if direction == "higher" else F.min
    b = F.when(F.col("labeled_cycle") == cycle, F.col("target"))
    return master.where("status = 'labeled'").agg(F.round(F.avg(b), 6).alias("batch_mean"), F.round(F.stddev_pop(b), 6).alias("batch_std"), F.min(b).alias("batch_min"), F.max(b).alias("batch_max"), best(b).alias("batch_best"), best("target").alias("best_so_far"))


def key_diversity(rows: DataFrame, key: str, batch: Column, name: str = "scaffold_diversity") -> DataFrame:
    """Distinct keys over rows that have one, in the batch and in all rows."""
    own = F.when(batch, F.col(key))
    return rows.agg(F.round(F.count_distinct(own) / F.count(own), 6).alias(f"{name}_batch"), F.round(F.count_distinct(key) / F.count(key), 6).alias(f"{name}_cumulative"))


def reservoir(rows: DataFrame, k: int = 100_000, seed: str = "0", key: str = "id") -> DataFrame:
    """A uniform sample of k rows without replacement: those of smallest counter hash, the same for any partitioning, and mergeable."""
    from ..functions import counter

    return order.best(rows.withColumn("__u", -counter.uniform(seed, F.col(key))), "__u", k, key).drop("__u")


def run_cache(rows: DataFrame, cycle: str, key: str, bits: str) -> DataFrame:
    """What a run accumulates, one row a cycle: rows, distinct keys and set bits so far, and the entropy of the bit positions so far."""
    own = Window.orderBy(cycle).rowsBetween(Window.unboundedPreceding, 0)  # one row a cycle
    new = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(cycle).alias(cycle)).groupBy(cycle).agg(F.count("*").alias("k"))
    seen = rows.groupBy(cycle).agg(F.count("*").alias("n"))
    at = rows.select(cycle, F.explode(bits).alias("bit")).groupBy("bit", cycle).agg(F.count("*").alias("c"))
    cycles = rows.select(cycle).distinct()
    # For each position its count up to each cycle: positions times cycles rows.
    so_far = at.select("bit", F.col(cycle).alias("__from"), "c").join(F.broadcast(cycles), F.col("__from") <= F.col(cycle)).groupBy(cycle, "bit").agg(F.sum("c").alias("c"))
    sums = so_far.groupBy(cycle).agg(F.sum("c").alias("bits"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    out = seen.join(new, cycle, "left").join(sums, cycle, "left")
    return out.select(cycle, F.sum("n").over(own).alias("seen"), F.coalesce(F.sum("k").over(own), F.lit(0)).alias("keys"), F.coalesce("bits", F.lit(0)).alias("bits"), F.round(F.log2("bits") - F.col("s") / F.col("bits"), 6).alias("bit_entropy"))


def change_of(value: str, percent: bool, run: str = "run_id", cycle: str = "cycle") -> Column:
    """up, down or same against the cycle before (none in the first): less than 1 counts as same for percentages, less than 0.01 for others."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(run).orderBy(cycle))
    return F.when(step.isNull(), "none").when(F.abs(step) < (1.0 if percent else 0.01), "same").when(step > 0, "up").otherwise("down")


def evaluate_cycle(pool: DataFrame, predictions: DataFrame, selected: DataFrame, batch: DataFrame, cycle: int, direction: str = "higher", keep: Callable[[DataFrame], DataFrame] = as_is) -> DataFrame:
    """One row with a cycle's metrics.

    pool: id, target, activity of all candidates; predictions: id, prediction and, if computed, uncertainty; selected: ids so
    far; batch: ids of this cycle. Metrics whose input is missing are null. The best are those of highest target ('higher')
    or lowest; ties go to the smaller id. The truth of the unlabeled rows is joined once, for one ranking that overlap,
    enrichment and correlation share.
    """
    sign = 1 if direction == "higher" else -1
    pool = pool.withColumn("__good", sign * F.col("target"))
    truth = pool.withColumn("target", F.col("__good"))
    parts = [batch.agg(F.lit(cycle).alias("cycle"), F.count("*").alias("batch_size")), selected.agg(F.count("*").alias("cumulative_labeled"))]
    own = pool.join(batch.select("id"), "id", "left_semi")
    parts.append(own.agg(F.round(F.avg("target"), 6).alias("avg_score_selected")))
    parts.append(pool.agg(F.round(F.avg("target"), 6).alias("ground_truth_avg_score")))
    if "uncertainty" in predictions.columns:
        parts.append(predictions.agg(F.round(F.avg("uncertainty"), 6).alias("uncertainty_mean"), F.round(F.stddev_pop("uncertainty"), 6).alias("uncertainty_std")))
    parts.append(discovery(truth, selected))
    if "activity" in pool.columns:
        parts.append(enrichment(pool, selected).select(F.col("enrichment").alias("cumulative_ef")))
        parts.append(enrichment(pool, batch).select(F.col("enrichment").alias("batch_ef"), F.col("hit_rate").alias("batch_hit_rate")))
        parts.append(enrichment_at(truth, "target", (5.0, 1.0, 0.5, 0.1)).transform(lambda x: x.toDF(*(f"ground_truth_{c}" for c in x.columns))))
    parts.append(improvement_ratio(pool, selected, sign=sign).toDF("cumulative_score_improvement_ratio"))
    parts.append(improvement_ratio(pool, batch, sign=sign).toDF("batch_score_improvement_ratio"))
    left = predictions.join(selected.select("id"), "id", "left_anti").select("id", (sign * F.col("prediction")).alias("prediction"))
    merged = left.hint("merge").join(truth.select("id", "target", *(c for c in ("activity",) if c in pool.columns)), "id")
    both = two_ranks(merged, "prediction", "target", descending=True, keep=keep)
    k = sizes(F.col("total"), (100, 1000), ())
    ra, rb = F.col("rank_a") + (F.col("ties_a") - 1) / 2, F.col("rank") + (F.col("ties") - 1) / 2
    shared = [F.round(100 * F.sum(((F.col("position_a") <= v) & (F.col("position") <= v)).cast("int")) / F.max(v), 6).alias(f"unlabeled_top_{n}_overlap") for n, v in k.items()]
    found = F.corr(ra, rb)
    if "activity" in pool.columns:
        for p, n in ((1.0, "1_0"), (5.0, "5_0")):
            top = F.greatest(F.lit(1), F.floor(F.col("total") * p / 100))
            shared.append(F.round(F.max("total") * F.sum(F.when(F.col("position_a") <= top, F.col("activity")).otherwise(0)) / (F.sum("activity") * F.max(top)), 6).alias(f"unlabeled_ef_{n}"))
    parts.append(both.agg(*shared, F.round(F.when(~F.isnan(found), found), 6).alias("unlabeled_spearman_correlation")))
    parts.append(selected_percentile(pool, batch, "target", direction))
    parts.append(histogram_entropy(left, "prediction"))
    kinds = [StructField(f.name, f.dataType) for x in parts for f in x.schema]
    return pool.sparkSession.createDataFrame([tuple(v for x in parts for v in x.first())], StructType(kinds))  # one row each


class Timings:
    """Seconds of the parts of a cycle; with timings("training"): ... adds to that part."""

    PARTS = ("training", "prediction", "feature", "acquisition", "oracle", "evaluation")

    def __init__(self) -> None:
        self.seconds = dict.fromkeys(self.PARTS, 0.0)
        self.began = time.perf_counter()

    @contextmanager
    def __call__(self, part: str) -> Iterator[None]:
        at = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[part] += time.perf_counter() - at

    def row(self) -> dict[str, float]:
        return {f"{k}_time": round(v, 6) for k, v in self.seconds.items()} | {"total_time": round(time.perf_counter() - self.began, 6)}


def histogram_entropy(rows: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Entropy of equal bins over [min, max], each with a small constant; 0 for a constant column."""
    ends = rows.agg(F.min(value).alias("a"), F.max(value).alias("b"), F.count(value).alias("n"))
    b = F.least(F.floor((F.col(value) - F.col("a")) / ((F.col("b") - F.col("a")) / bins)), F.lit(bins - 1)).cast("int")
    counts = rows.where(F.col(value).isNotNull()).join(F.broadcast(ends), F.lit(True)).where("b > a").groupBy(b.alias("bin"), "n").agg(F.count("*").alias("c"))
    p = (F.col("c") / F.col("n") + 1e-10 / bins) / (1 + 1e-10)
    empty = (1e-10 / bins) / (1 + 1e-10)
    return counts.agg(F.round(F.coalesce(-F.sum(p * F.log(p)) - (bins - F.count("*")) * empty * F.log(F.lit(empty)), F.lit(0.0)) + 0.0, 6).alias("prediction_entropy"))


def improvement_ratio(pool: DataFrame, selected: DataFrame, value: str = "target", sign: int = 1) -> DataFrame:
    rows = pool.join(selected.select("id", F.lit(1).alias("__hit")), "id", "left")
    a = rows.agg(F.avg(F.when(F.col("__hit") == 1, F.col(value))).alias("s"), F.avg(value).alias("m"))
    gain = sign * (F.col("s") - F.col("m"))
    return a.select(F.round(F.when(F.col("m") != 0, gain / F.abs("m")).when(gain == 0, 0.0).otherwise(gain * float("inf")), 6).alias("improvement_ratio"))


def sampled_pairs(n: int, count: int, seed: int, pairs: dict[tuple[int, int], None]) -> None:
    """Adds distinct pairs i < j below n, drawn by counter hashes, until pairs has so many; n must have more."""
    draw = 0
    while len(pairs) < count:
        h = hashlib.md5(f"{seed}:{draw}".encode()).digest()
        i, j = (int.from_bytes(x, "big") % n for x in (h[:8], h[8:]))
        if i != j:
            pairs[min(i, j), max(i, j)] = None
        draw += 1


def mean_tanimoto(vectors: DataFrame, seed: int = 42) -> DataFrame:
    """mean_tanimoto, n_pairs: the mean similarity of the bit sets b of all rows (id, b), rows without b left out.

    All pairs up to 1000; beyond, 500 pilot pairs give the number for a 95 % half-width of 0.005, between 1000 and 100000.
    """
    spark = vectors.sparkSession
    rows = indexed(vectors.where("b IS NOT NULL").select("id", "b"), "id").select(F.col("global_index").alias("i"), "b")
    n = rows.count()
    total = n * (n - 1) // 2
    both = F.size(F.array_intersect("x", "y"))
    each = F.size("x") + F.size("y")
    tanimoto = F.when(each == 0, 1.0).otherwise(both / (each - both))

    def every() -> DataFrame:
        return rows.toDF("i", "x").join(F.broadcast(rows.toDF("j", "y")), F.expr("i < j"))

    def of(pairs: dict) -> DataFrame:
        wanted = spark.createDataFrame(list(pairs), "i long, j long")
        met = rows.join(F.broadcast(wanted.select(F.explode(F.array("i", "j")).alias("i")).distinct()), "i")
        return wanted.join(met.toDF("i", "x"), "i").join(met.toDF("j", "y"), "j")

    if total <= 1000:
        drawn = every()
    else:
        pairs: dict[tuple[int, int], None] = {}
        sampled_pairs(n, 500, seed, pairs)
        std = of(pairs).agg(F.stddev_samp(tanimoto)).first()[0] or 0.0
        count = max(1000, min(math.ceil((1.96 * std / 0.005) ** 2), 100_000))
        if total > count:
            sampled_pairs(n, count, seed, pairs)
        drawn = of(pairs) if total > count else every()
    return drawn.agg(F.round(F.avg(tanimoto), 6).alias("mean_tanimoto"), F.count("*").alias("n_pairs"))

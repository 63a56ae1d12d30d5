"""Analytics over runs: curves, replicates, overlaps, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact


def run_aggregates(rows: DataFrame, value: str, finals: list[str], run: str = "run_id", cycle: str = "cycle") -> DataFrame:
    """Per run: mean and deviation (population) of value, its best and the first cycle that reaches it, last and mean values of the others.
    Nulls are passed over, the last value is the last that there is."""
    first = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(value), -F.col(cycle))))  # the least cycle of a tied best
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(cycle)))
    r = lambda c, n: F.round(c, 6).alias(n)
    return rows.groupBy(run).agg(
        r(exact.mean(value), f"avg_{value}"), r(F.stddev_pop(value), f"std_{value}"), r(F.max(value), "best"), (-first["col2"]).alias("best_cycle"), r(last(value), f"final_{value}"),
        *(x for c in finals for x in (r(last(c), f"final_{c}"), r(exact.mean(c), f"avg_{c}"))), F.count("*").alias("total_cycles"),
    )


def curve(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Mean x, and mean, least and largest y of the replicates."""
    return rows.groupBy(*by).agg(F.round(F.avg(x), 6).alias("mean_x"), F.round(F.avg(y), 6).alias("mean"), F.round(F.min(y), 6).alias("low"), F.round(F.max(y), 6).alias("high"), F.count("*").alias("n"))


def short_groups(rows: DataFrame, group: str) -> DataFrame:
    """Groups with fewer rows than most groups have (of equally common sizes the larger)."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    usual = sizes.groupBy("n").agg(F.count("*").alias("c")).agg(F.max(F.struct("c", "n"))["n"].alias("usual"))
    return sizes.crossJoin(F.broadcast(usual)).where("n < usual")  # one row


def constant_share(rows: DataFrame, run: str, hit: Column, tolerance: float) -> DataFrame:
    """Least and largest share of rows that hit among runs, and whether they agree."""
    shares = rows.groupBy(run).agg(F.round(F.count_if(hit) / F.count("*"), 6).alias("f"))
    return shares.agg(F.min("f").alias("least"), F.max("f").alias("most"), (F.max("f") - F.min("f") <= tolerance).alias("constant"))


def lost(states: DataFrame, top: DataFrame, run: str, name: str) -> DataFrame:
    """Per run, how many of the top ids are pruned."""
    return states.join(top.select("id"), "id", "left_semi").groupBy(run).agg(F.count_if(F.col("status") == "pruned").alias(name))


def two_levels(rows: DataFrame, by: str, run: str) -> DataFrame:
    """Rows by group and run, and their mean, least and largest number over runs."""
    return rows.groupBy(by, run).agg(F.count("*").alias("c")).groupBy(by).agg(F.round(F.avg("c"), 6).alias("mean"), F.min("c").alias("low"), F.max("c").alias("high"))


def overlaps(sets: DataFrame, name: str, key: str) -> DataFrame:
    """Share (%) of equally large sets that two of them have in common; one join on the key."""
    sizes = sets.groupBy(name).agg(F.count_distinct(key).alias("n")).agg(F.min("n").alias("low"), F.max("n").alias("high")).first()
    if sizes["low"] != sizes["high"]:
        raise ValueError("the sets differ in size")
    rows = sets.select(name, key).distinct()
    both = rows.join(rows.select(key, F.col(name).alias("r")), key)
    return both.groupBy(name, "r").agg(F.round(100 * F.count("*") / F.lit(float(sizes["high"] or 1)), 6).alias("overlap"))


def campaign_hours(spark: SparkSession, pools: list[float], costs: list[float], workers: list[int], share: float, setup: float, rate: float) -> DataFrame:
    """Hours of a campaign by pool size and cost of a measurement; workers divide the oracle's part only."""
    table = lambda x, n, kind: spark.createDataFrame([(v,) for v in x], f"{n} {kind}")
    grid = table(pools, "pool", "double").crossJoin(table(costs, "cost", "double")).crossJoin(table(workers, "workers", "int"))  # a grid of settings
    return grid.withColumn("hours", F.round((setup + (rate + share * F.col("cost") / F.col("workers")) * F.col("pool")) / 3600, 9))

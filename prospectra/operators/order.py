"""Ranks over a whole table without one task for all rows.

A sample of rows gives cut points in the order (value, key), so that equal values are parted by key, too; each range is one
task's share, and a rank is the row's number in its range plus the rows of the ranges before. Cut points only balance the
ranges: the ranks are exact whatever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about; ranges at most (beyond, ranges grow); sampled rows a range.
RANGE_ROWS, RANGES, SAMPLED = 250_000, 8192, 24
#: Rows up to which the best k are kept in each task; more are cut off by rank.
TOP = 100_000
#: Groups whose bounds are sent to every executor.
FEW = 10_000


def _ranges(n: int) -> int:
    """Into how many ranges n rows are cut."""
    return min(RANGES, -(-n // RANGE_ROWS))


def _cuts(rows: DataFrame, n: int) -> DataFrame | None:
    """One row with the sorted array cuts of (v, k), or None where one range is enough."""
    ranges = _ranges(n)
    if ranges < 2:
        return None
    want = ranges * SAMPLED
    share = max(1, n // want)
    sample = rows.where(F.pmod(F.xxhash64("__k"), F.lit(share)) == 0).select("__v", "__k")
    sample = sample.orderBy(F.xxhash64("__k", F.lit(1)), "__k", "__v").limit(2 * want)  # a bound, if hashes repeat
    ordered = sample.groupBy().agg(F.sort_array(F.collect_list(F.struct("__v", "__k"))).alias("s"))  # at most 2 * want rows
    got = ordered.select(F.expr(f"transform(sequence(1, {ranges - 1}), i -> get(s, cast(floor(i * size(s) / {ranges}) AS int)))").alias("cuts"))
    return rows.sparkSession.createDataFrame([r.asDict() for r in got.collect()], got.schema)


def _range_of(cuts: Column, own: Column, count: int) -> Column:
    """How many cut points lie before a row: a binary search."""
    steps = [1 << x for x in reversed(range(count.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, d: F.when((lo + d <= F.size(cuts)) & (F.get(cuts, lo + d - 1) < own), lo + d).otherwise(lo))


def ranked(df: DataFrame, value: str | Column, key: str, descending: bool = False, ties: bool = True) -> DataFrame:
    """Adds position (1.., equal values by key), total and, with ties, rank (1 + rows strictly before by value) and ties (rows of equal value). Rows with a null value are dropped."""
    v = F.col(value) if isinstance(value, str) else value
    rows = df.withColumn("__v", -v if descending else v).where("__v IS NOT NULL").withColumn("__k", F.col(key))
    n = rows.count()
    cuts = _cuts(rows, n)
    if cuts is None:
        rows = rows.withColumn("__range", F.lit(0))
    else:
        found = _range_of(F.col("cuts"), F.struct("__v", "__k"), _ranges(n))
        rows = rows.crossJoin(F.broadcast(cuts)).withColumn("__range", found).drop("cuts")  # one row of at most RANGES cuts
    own = Window.partitionBy("__range")
    local = {"position": F.row_number().over(own.orderBy("__v", "__k")).cast("bigint")}
    if ties:
        local |= {"rank": F.rank().over(own.orderBy("__v")).cast("bigint"), "ties": F.count("*").over(Window.partitionBy("__range", "__v"))}
    out = rows.withColumns(local).withColumn("total", F.lit(n).cast("bigint"))
    if cuts is None:
        return out.drop("__v", "__k", "__range")
    spark = df.sparkSession
    ends = rows.groupBy("__range").agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")).orderBy("__range").collect()  # a row a range
    before, at = {}, 0
    for r in ends:
        before[r["__range"]] = at
        at += r["n"]
    offsets = spark.createDataFrame(list(before.items()), "__range int, __before long")
    out = out.join(F.broadcast(offsets), "__range").withColumn("position", F.col("position") + F.col("__before"))
    if ties:
        out = out.withColumn("rank", F.col("rank") + F.col("__before"))
        kind = rows.schema["__v"].dataType.simpleString()
        split = list({b["low"]: 1 for a, b in zip(ends, ends[1:]) if a["high"] == b["low"]})
        if split:  # values with rows in several ranges: fewer than ranges
            parts = spark.createDataFrame([(x,) for x in split], f"__v {kind}")
            counts = rows.join(F.broadcast(parts), "__v").groupBy("__v", "__range").agg(F.count("*").alias("n")).orderBy("__range").collect()
            sizes = {r["__range"]: r["n"] for r in ends}
            whole: dict = {}
            for r in counts:
                first, total = whole.get(r["__v"], (before[r["__range"]] + sizes[r["__range"]] - r["n"] + 1, 0))
                whole[r["__v"]] = (first, total + r["n"])
            parts = spark.createDataFrame([(k, a, b) for k, (a, b) in whole.items()], f"__v {kind}, __rank long, __ties long")
            out = out.join(F.broadcast(parts), "__v", "left").withColumns({"rank": F.coalesce("__rank", "rank"), "ties": F.coalesce("__ties", "ties")}).drop("__rank", "__ties")
    return out.drop("__v", "__k", "__range", "__before")


def indexed(df: DataFrame, key: str, width: int = 1 << 16) -> DataFrame:
    """Adds global_index: place of an integer key in ascending order, from 0."""
    rows = df.withColumn("__range", F.floor(F.col(key) / width))
    counts = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    rows = rows.withColumn("__i", F.row_number().over(Window.partitionBy("__range").orderBy(key)))
    return rows.join(before, "__range").withColumn("global_index", F.col("__before") + F.col("__i") - 1).drop("__range", "__i", "__before")


def running(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Adds __before, the sum of weight over rows of smaller value, and __all, that of all rows; values must be unique."""
    rows = df.withColumns({"__k": F.col(value)}) if value == "__v" else df.withColumns({"__v": F.col(value), "__k": F.col(value)})
    n = rows.count()
    cuts = _cuts(rows, n)
    if cuts is None:
        rows = rows.withColumn("__range", F.lit(0))
    else:
        rows = rows.crossJoin(F.broadcast(cuts)).withColumn("__range", _range_of(F.col("cuts"), F.struct("__v", "__k"), _ranges(n))).drop("cuts")  # one row of at most RANGES cuts
    sums = {r["__range"]: r["s"] or 0 for r in rows.groupBy("__range").agg(F.sum(weight).alias("s")).collect()}  # a row a range
    total, starts = 0, []
    for r in sorted(sums):
        starts.append((r, total))
        total += sums[r]
    kind = "double" if isinstance(total, float) else "long"
    starts = df.sparkSession.createDataFrame(starts, f"__range int, __start {kind}")
    own = Window.partitionBy("__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__here", F.coalesce(F.sum(weight).over(own), F.lit(0))).join(F.broadcast(starts), "__range")
    out = out.withColumns({"__before": F.col("__start") + F.col("__here"), "__all": F.lit(total)})
    return out.drop("__k", "__range", "__start", "__here", *([] if value == "__v" else ["__v"]))


def best(df: DataFrame, score: str, k: int, key: str = "id") -> DataFrame:
    """The k rows of highest score, ties to the smaller key; null and NaN scores come last. Up to TOP rows plan as a bounded top-k, more are cut off by their exact rank."""
    if k < 0:
        raise ValueError("k must not be negative")
    worst = F.when(F.isnan(score) | F.col(score).isNull(), F.lit(float("-inf"))).otherwise(F.col(score).cast("double"))
    if k > TOP:
        return ranked(df, worst, key, descending=True, ties=False).where(F.col("position") <= k).drop("position", "total")
    return df.withColumn("__s", worst).orderBy(F.desc("__s"), F.asc(key)).limit(k).drop("__s")


def at_quantiles(df: DataFrame, value: str, key: str, shares: dict[str, float]) -> DataFrame:
    """One row with a column for each share: the linearly interpolated quantile, from the rows at two exact ranks."""
    rows = ranked(df, value, key, ties=False)
    out = []
    for name, share in shares.items():
        place = (F.col("total") - 1) * share
        low, part = F.floor(place), place - F.floor(place)
        x = lambda at: F.max(F.when(F.col("position") == at + 1, F.col(value)))
        low_value, high_value = x(low), x(F.least(low + 1, F.col("total") - 1))
        out.append((low_value + F.max(part) * (high_value - low_value)).alias(name))
    return rows.agg(*out)


def group_medians(df: DataFrame, group: str, value: str, key: str, name: str = "median") -> DataFrame:
    """group and the median of value in it, by exact ranks in the order (group, value); no group is gathered."""
    rows = ranked(df.where(F.col(value).isNotNull()), F.struct(group, value), key, ties=False)
    starts = rows.groupBy(group).agg(F.min("position").alias("__first"), F.count("*").alias("__n"))
    # The middle rows are two a group; the groups' bounds come back by a join on the group, which few groups don't shuffle for.
    starts = F.broadcast(starts) if starts.limit(FEW + 1).count() <= FEW else starts
    at = F.col("position") - F.col("__first")
    middle = rows.join(starts, group).where((at == F.floor((F.col("__n") - 1) / 2)) | (at == F.floor(F.col("__n") / 2)))
    return middle.groupBy(group).agg(F.avg(value).alias(name))



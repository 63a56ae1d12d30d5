"""Operator 1, mixing sources to target weights: Poisson replication and a global shuffle.

Each source gets a mean repetition rate, weight * rows / rows of the source; a uniform number from a hash of the
document's key and the seed goes through the inverse Poisson distribution of that mean and gives the number of copies.
The copies are dealt out by a hash and sorted by it, so that any run of output rows is a uniform sample of the mixture.

Only counts by source are joined back: broadcast if a count shows few sources, else salted, so that a source with a
third of all rows is read by many tasks. A null source is a source of its own, named "". Sources without a given weight
share `rest`; a weight of 0 drops a source. Rows with equal keys get equal numbers of copies; a
null key counts as empty. Empty tables stay empty. Texts of any length go through as they are, and so do other columns; one
named copy or mix_key raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SEED = "mix-1"
#: Copies that one row of the first explode stands for, at most; a second explode after the shuffle gives the rest.
BLOCK = 1024
#: Sources up to which their rates are sent to every executor; each row has a CDF of some dozen numbers.
SOURCES = 20_000


def uniform(key: Column, seed: str) -> Column:
    """In [0, 1), 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def log_factorial(k: Column) -> Column:
    """Exact to 20!, Stirling's series beyond (error below 1e-13)."""
    x = k.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(k <= 20, F.log(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def poisson_table(mean: Column) -> tuple[Column, Column]:
    """The first count and the array of the distribution function from there; what lies outside has less than 1e-15."""
    wide = 12 * F.sqrt(mean) + 30
    low = F.greatest(F.lit(0), F.floor(mean - wide)).cast("long")
    pmf = F.transform(F.sequence(low, F.ceil(mean + wide).cast("long")), lambda k: F.exp(k * F.log(mean) - mean - log_factorial(k)))
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("all"))
    # Sums of prefixes: the array grows by concatenation only here, once for each source.
    return low, F.aggregate(pmf, start, lambda a, p: F.struct((a["s"] + p).alias("s"), F.concat(a["all"], F.array(a["s"] + p)).alias("all")), lambda a: a["all"])


def mix(docs: DataFrame, weights: dict[str, float], rest: float = 0.0, epochs: float = 1.0, key: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """Columns of docs with copy (from 0) and mix_key; rows in the order of mix_key within partitions that it deals out.

    weights: share of each source in the result, rest: the share that all others have together; they needn't add up to 1.
    epochs: expected rows of the result as a multiple of the input's. Text is shuffled once, by mix_key.
    """
    spark = docs.sparkSession
    C.refuse(docs, "copy", "mix_key")
    src = F.coalesce(F.col(source).cast("string"), F.lit(""))
    stats = docs.groupBy(src.alias("__s")).agg(F.count("*").alias("__n"))
    named = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "__s string, __w double")
    stats = C.written(stats.join(F.broadcast(named), "__s", "left"), "mix")
    total, others, weight = stats.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("__w").isNull(), F.col("__n"))), F.lit(0)), F.coalesce(F.sum("__w"), F.lit(0.0))).first()
    whole = weight + (rest if others else 0.0)
    share = F.coalesce(F.col("__w"), F.lit(rest) * F.col("__n") / F.lit(float(max(others, 1)))) / F.lit(whole or 1.0)
    stats = stats.withColumn("__mean", share * F.lit(float(total) * epochs) / F.col("__n"))
    low, cdf = poisson_table(F.col("__mean"))
    stats = stats.where("__mean > 0").select("__s", low.alias("__low"), cdf.alias("__cdf"))
    u = uniform(F.col(key), seed)
    rows = docs.withColumn("__s", src).withColumn("__u", u)
    if stats.limit(SOURCES + 1).count() <= SOURCES:
        rows = rows.join(F.broadcast(stats), "__s")
    else:
        salts = 64
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64(F.col(key)), F.lit(salts)).cast("int"))
        rows = rows.join(stats.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["__s", "__salt"]).drop("__salt")
    count = F.col("__low") + F.size(F.filter("__cdf", lambda p: p <= F.col("__u")))
    rows = rows.withColumn("__k", count).where("__k > 0").drop("__s", "__u", "__low", "__cdf")
    rows = rows.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1, F.lit(BLOCK).cast("long"))))
    copies = F.sequence(F.col("__from"), F.least(F.col("__k"), F.col("__from") + BLOCK) - 1)
    rows = rows.withColumn("copy", F.explode(copies)).drop("__k", "__from")
    rows = rows.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("copy").cast("string")).cast("binary")))
    return rows.repartition(F.col("mix_key")).sortWithinPartitions("mix_key")

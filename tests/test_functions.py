import math
from statistics import NormalDist

from pyspark.sql import functions as F

from prospectra.functions import counter, exact, normal


def test_cdf_and_quantile(spark):
    xs = [-37.0, -8.0, -7.0, -1.5, 0.0, 0.3, 1.96, 6.9, 7.2, 30.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(F.expr(normal.cdf("x"))).collect()
    for x, r in zip(xs, got, strict=True):
        assert abs(r[0] - 0.5 * math.erfc(-x / math.sqrt(2))) < 1e-14
    ps = [1e-12, 1e-5, 0.07, 0.3, 0.5, 0.9, 0.999, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(F.expr(normal.quantile("p"))).collect()
    for p, r in zip(ps, got, strict=True):
        assert abs(r[0] - NormalDist().inv_cdf(p)) < 1e-9


def test_counter_does_not_depend_on_partitions(spark):
    one = {r[0]: r[1] for r in spark.range(100).repartition(1).select("id", counter.uniform(3, F.col("id"))).collect()}
    many = {r[0]: r[1] for r in spark.range(100).repartition(17).select("id", counter.uniform(3, F.col("id"))).collect()}
    assert one == many and all(0 < v < 1 for v in one.values())


def test_exact_mean(spark):
    """Digits add up; the plain mean where they can't."""
    nan, inf = float("nan"), float("inf")
    cases = {"digits": ([0.1, 0.2, 0.3], 0.2), "nulls": ([None, 4.0, 5.0], 4.5), "none": ([None], None), "nan": ([nan, 1.0], nan), "inf": ([inf, 1.0], inf), "large": ([1e300, 3e300], 2e300), "past": ([6e19, 9e19], 7.5e19), "small": ([1e-30, 3e-30], 2e-30), "zero": ([0.0, -0.0], 0.0)}
    rows = spark.createDataFrame([(k, x) for k, (v, _) in cases.items() for x in v], "k string, x double")
    for k, got in rows.groupBy("k").agg(exact.mean("x")).collect():
        want = cases[k][1]
        assert got == want or math.isnan(got) and math.isnan(want), k

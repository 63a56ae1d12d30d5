import numpy as np
import pytest
from pyspark.sql import functions as F

from prospectra.errors import ConfigError, EngineWarning, FeatureError
from prospectra.functions import splitmix
from prospectra.operators import features, transforms
from prospectra.operators import neighbours as N


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, structure string")


def test_store_computes_each_text_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    store = features.Store(spark, str(tmp_path), kept=1)
    df = rows(spark, ["CCOC", "CCNC", "CCOC", None, "", "C" * 10_001])
    first = store.get(df, "lingo")
    got = {r["id"]: r["features"] for r in first.collect()}
    assert got[0] == got[2] and got[0] != got[1] and got[3] is None and got[4] is None and got[5] is None
    f = features.featurizer("lingo")
    assert store.table(f).count() == 2 and store.misses(df, f).count() == 0 and store.hits(df, f).count() == 3
    more = store.get(rows(spark, ["CCOC", "OCOC"]), f)
    assert more.count() == 2 and store.table(f).count() == 3 and not any(store.faults(f).values())
    store.get(df, "minhash")
    assert len(store.cached) == 1  # the least lately used table went
    store.table(f).limit(1).select("key", "features", "part").write.mode("append").partitionBy("part").parquet(store.path(f))
    store.forget(f)
    with pytest.raises(FeatureError):
        store.validate(f)
    assert calls.value == 0


def test_keys_differ_by_featurizer_and_settings(spark):
    keys = {rows(spark, ["CC"]).select(features.key_of(F.col("structure"), f)).first()[0] for f in (features.lingo(), features.lingo(512), features.minhash())}
    assert len(keys) == 3


def test_registry_and_guard():
    with pytest.raises(FeatureError):
        features.featurizer("morgan")
    with pytest.raises(ConfigError):
        features.featurizer("nothing")
    features.register("own", lambda: features.Featurizer("own", lambda t: F.array(F.length(t)), 1, "continuous"))
    wide = features.Featurizer("wide", lambda t: F.array(), 300, "continuous")
    features.guard(wide, 10_000_000)
    features.guard(features.lingo(), 10**9)
    with pytest.raises(ConfigError):
        features.guard(wide, 10_000_001)
    with pytest.warns(EngineWarning):
        features.guard(wide, 10_000_001, True)


def test_packed_and_sparse_forms(spark):
    data = [(0, []), (1, [1]), (2, [0, 1] * 40), (3, [0] * 33), (4, [1] * 64)]
    df = spark.createDataFrame(data, "id long, b array<int>").withColumn("w", N.pack("b"))
    for r in df.withColumn("back", N.unpack("w", F.size("b"))).collect():
        assert r["back"] == r["b"] and len(r["w"]) == -(-len(r["b"]) // 32)
    got = df.where("id < 4 AND id <> 1").withColumn("s", features.to_sparse("b")).withColumn("back", features.from_sparse("s")).collect()
    assert all(r["back"] == r["b"] for r in got)
    for bad in (df.where("id = 4").select(features.to_sparse("b")), df.limit(1).select(F.array(F.lit(256)).alias("x")).select(features.to_uint8("x")), df.limit(1).select(F.array(F.lit(0.5)).alias("x")).select(features.to_uint8("x"))):
        with pytest.raises(Exception):
            bad.collect()


def test_append_refuses_repeated_keys(spark):
    a = spark.createDataFrame([("x", 1)], "key string, v int")
    assert features.append_unique(a, a.withColumn("key", F.lit("y"))).count() == 2
    with pytest.raises(Exception):
        features.append_unique(a, a).collect()


def test_pool_validation(spark):
    got = {r["id"]: r["error"] for r in features.validate_pool(spark.createDataFrame([(1, " CC "), (2, ""), (3, "X"), (4, "a"), (4, "b")], "id long, structure string"), form=lambda c: F.when(c != "X", F.trim(c))).collect()}
    assert got == {1: None, 2: "empty", 3: "invalid structure", 4: "repeated id"}


def test_transforms_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5))
    x[:, 2] = 3.0
    x[::7, 1] = np.nan
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    back = lambda d: np.array([r["features"] for r in d.orderBy("id").collect()])
    filled = np.where(np.isnan(x), np.nanmedian(x, 0), x)
    got = transforms.Impute().fit(df).transform(df)
    assert np.allclose(back(got), filled) and back(transforms.Impute("binary").fit(df).transform(df))[0, 1] == 0
    assert transforms.VarianceMask().fit(got).kept == [0, 1, 3, 4]
    scale = transforms.Scale().fit(got.where("id < 40"))
    std = filled[:40].std(0)
    assert np.allclose(back(scale.transform(got)), (filled - filled[:40].mean(0)) / np.where(std > 0, std, 1))
    lower = np.linalg.cholesky(filled.T @ filled)
    assert np.allclose(transforms.leverage(filled, lower), np.diag(filled @ np.linalg.inv(filled.T @ filled) @ filled.T))


def test_splitmix_against_integers(spark):
    values = [0, 1, 2**31, 2**63 - 1, -1, -(2**63), 123456789012345]
    got = spark.createDataFrame([(v,) for v in values], "x long").select("x", splitmix.mix(F.col("x")).alias("m"), splitmix.multiply(F.col("x"), splitmix.M1).alias("p"), splitmix.add(F.col("x"), splitmix.GAMMA).alias("a")).collect()
    for r in got:
        u = r["x"] % 2**64
        assert r["m"] % 2**64 == splitmix.plain_mix(u) and r["p"] % 2**64 == u * splitmix.M1 % 2**64 and r["a"] % 2**64 == (u + splitmix.GAMMA) % 2**64


def test_counts_hash_each_substring_once(spark):
    """Counts agree with a plain count, and cost a few passes over the substrings, not one for each place."""
    import hashlib
    import time
    from collections import Counter

    texts = ["abcdabcd", "abc", "", "aaaaaaa", "x" * 300, "".join(chr(97 + i * i % 26) for i in range(500))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, structure string")
    for size in (1, 7, 256):
        f = features.lingo_counts(size)
        got = {r["id"]: r["x"] for r in rows.select("id", f.features(F.col("structure")).alias("x")).collect()}
        for i, t in enumerate(texts):
            c = Counter(int(hashlib.md5(t[j : j + 4].encode()).hexdigest()[:8], 16) % size for j in range(len(t) - 3))
            assert got[i] == [c[p] for p in range(size)]
    long = spark.range(0, 8, 1, 1).select(F.concat(F.repeat(F.lit("abcdefghij"), 300), F.col("id").cast("string")).alias("t"))

    def seconds(column):
        began = time.perf_counter()
        long.select(column.alias("x")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    one = F.transform(features.grams(F.col("t"), 4), lambda g: features.place_of(g, 256))
    all_places = features.lingo_counts().features(F.col("t"))
    seconds(one), seconds(one)
    assert seconds(all_places) < 30 * seconds(one) + 1

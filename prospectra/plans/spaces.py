"""Queries of features, similarity, neighbours, transforms, learners and ensembles."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..operators import features, learners, oracles, transforms
from ..operators import neighbours as N
from . import views as V
from .registry import add

BITS = "(SELECT vec_id AS id, list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0) AS b FROM embeddings)"
SIM = "coalesce(len(list_intersect(a.b, c.b)) / (len(a.b) + len(c.b) - len(list_intersect(a.b, c.b))), 1)"
#: Each query's rows by similarity, ties to the smaller id. Queries have ids divisible by 100, against all rows.
NEAR = f"(SELECT a.id, c.id AS neighbour, {SIM} AS s, row_number() OVER (PARTITION BY a.id ORDER BY round({SIM}, 12) DESC, c.id) AS place FROM {BITS} a, {BITS} c WHERE a.id % 100 = 0 AND a.id <> c.id)"
RESIDUAL = "((neighbour * 7919) % 101 / 10.0)"


def bits(spark, d):
    return V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), N.positive_bits("embedding").alias("vector"))


def asked(rows):
    return rows.where("id % 100 = 0")


def with_residual(spark, d):
    return bits(spark, d).withColumn("residual", (F.col("id") * 7919) % 101 / 10.0)


@add("max_similarity", f"SELECT id, round(s, 6) AS similarity FROM {NEAR} WHERE place = 1")
def max_similarity(spark, d):
    rows = bits(spark, d)
    return N.max_similarity(asked(rows), rows).select("id", F.round("similarity", 6).alias("similarity"))


@add("median_nn", f"SELECT round(median(s), 6) AS median_nn FROM {NEAR} WHERE place = 1")
def median_nn(spark, d):
    rows = bits(spark, d)
    from ..operators import order

    return order.at_quantiles(N.max_similarity(asked(rows), rows), "similarity", "id", {"m": 0.5}).select(F.round("m", 6).alias("median_nn"))


@add("knn_residual", f"SELECT id, round(avg({RESIDUAL}), 6) AS local_residual FROM {NEAR} WHERE place <= 5 GROUP BY id")
def knn_residual(spark, d):
    rows = with_residual(spark, d)
    return N.local_residuals(asked(rows), rows, "residual", 5).select("id", F.round("local_residual", 6).alias("local_residual"))


@add("neighbour_features", f"SELECT id, round(max(s), 6) AS similarity_max, round(min(s), 6) AS similarity_min, round(avg(s), 6) AS similarity_mean, round(avg(r), 6) AS residual_mean, round(median(r), 6) AS residual_median, round(stddev_pop(r), 6) AS residual_std, round(quantile_cont(r, 0.9), 6) AS residual_q90 FROM (SELECT *, {RESIDUAL}::DOUBLE AS r FROM {NEAR} WHERE place <= 25) GROUP BY id")
def neighbour_features(spark, d):
    rows = with_residual(spark, d)
    out = N.neighbour_features(asked(rows), rows, "residual", 25)
    return out.select("id", *(F.round(c, 6).alias(c) for c in out.columns if c != "id"))


@add("cosine_neighbours", "SELECT id, neighbour, round(s, 6) AS similarity, place::INT AS place FROM (SELECT a.vec_id AS id, c.vec_id AS neighbour, list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12) DESC, c.vec_id) AS place FROM embeddings a, embeddings c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id) WHERE place <= 5")
def cosine_neighbours(spark, d):
    rows = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return N.nearest(asked(rows), rows, 5, "cosine").select("id", "neighbour", F.round("similarity", 6).alias("similarity"), "place")


@add("cosine_distance", "SELECT a.vec_id AS id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS distance FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) c")
def cosine_distance(spark, d):
    rows = V.table(spark, d, "embeddings")
    one = rows.orderBy("vec_id").limit(1).select(F.col("embedding").alias("other"))
    return rows.crossJoin(F.broadcast(one)).select(F.col("vec_id").alias("id"), F.round(1 - N.cosine(F.col("embedding"), F.col("other")), 6).alias("distance"))  # one row


FIRST = f"(SELECT b FROM {BITS} ORDER BY id LIMIT 1)"


def reference(rows):
    return rows.orderBy("id").limit(1).select(N.pack("vector")).first()[0]


for metric, form in (("tanimoto", SIM), ("dice", "coalesce(2 * len(list_intersect(a.b, c.b)) / (len(a.b) + len(c.b)), 1)")):
    @add(f"similarity_oracle_{metric}", f"SELECT a.id, round({form}, 6) AS value FROM {BITS} a, {FIRST} c")
    def similarity_oracle(spark, d, metric=metric):
        rows = bits(spark, d)
        oracle = oracles.SimilarityOracle(rows.withColumn("w", N.pack("vector")), "w", reference(rows), metric)
        return oracle.values(rows.select("id")).select("id", F.round("value", 6).alias("value"))


@add("bitpack_roundtrip", f"SELECT id, len(b) AS ones, true AS same, 2 AS words FROM {BITS}")
def bitpack_roundtrip(spark, d):
    rows = bits(spark, d).withColumn("w", N.pack("vector"))
    return rows.select("id", N.ones(F.col("w")).alias("ones"), (N.unpack("w", F.size("vector")) == F.col("vector")).alias("same"), F.size("w").alias("words"))


@add("sparse_roundtrip", "SELECT vec_id AS id, len(list_filter(embedding, lambda x: x > 0.2)) AS cells, true AS same FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.2)) <= 32")
def sparse_roundtrip(spark, d):
    rows = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.when(x > 0.2, 1).otherwise(0)).alias("v"))
    rows = rows.where(F.size(F.filter("v", lambda x: x != 0)) <= features.DENSITY * F.size("v")).withColumn("s", features.to_sparse("v"))
    return rows.select("id", F.size("s.indices").alias("cells"), (features.from_sparse("s") == F.col("v")).alias("same"))


STRUCTURE = "(SELECT p_partkey AS id, p_name || ' ' || p_type AS t FROM part)"
GRAMS = f"(SELECT id, unnest(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4))) AS g FROM {STRUCTURE})"
PLACE = "(('0x' || substr(md5(g), 1, 8))::BIGINT % {0})"


def structures(spark, d):
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("structure"))


@add("lingo", f"SELECT id, list_sort(list_distinct(list({PLACE.format(1024)}::INT))) AS ones FROM {GRAMS} GROUP BY id")
def lingo(spark, d):
    out = features.extract(structures(spark, d), "lingo")
    return out.select("id", F.filter(F.transform("features", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull()).alias("ones"))


@add("lingo_counts", f"SELECT id, p::INT AS place, count(*) AS n FROM (SELECT id, {PLACE.format(256)} AS p FROM {GRAMS}) GROUP BY id, p")
def lingo_counts(spark, d):
    rows = structures(spark, d).repartition(spark.sparkContext.defaultParallelism)  # much work for few bytes: one file would be one task
    out = features.extract(rows, "lingo_counts")
    return out.select("id", F.posexplode("features").alias("place", "n")).where("n > 0").withColumn("n", F.col("n").cast("bigint"))


@add("feature_key", "SELECT id, substr(sha256(concat_ws(chr(31), t, 'lingo', '{\"kind\": \"binary\", \"q\": 4, \"size\": 1024}')), 1, 32) AS \"key\" FROM " + STRUCTURE)
def feature_key(spark, d):
    return structures(spark, d).select("id", features.key_of(F.col("structure"), features.featurizer("lingo")).alias("key"))


@add("feature_store", f"SELECT id, len(list_distinct(list({PLACE.format(1024)}::INT))) AS ones FROM {GRAMS} GROUP BY id")
def feature_store(spark, d):
    """Half of the rows are stored first; the second call finds them and computes the rest."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="prospectra-")
    import uuid

    store, rows = features.Store(spark, f"{folder}/store-{uuid.uuid4().hex}"), structures(spark, d)
    store.get(rows.where("id % 2 = 0"), "lingo")
    out = store.get(rows, "lingo")
    store.validate("lingo")
    return out.select("id", F.aggregate("features", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("ones"))


@add("pool_validation", "SELECT l_partkey AS id, CASE WHEN c > 1 THEN 'repeated id' WHEN trim(t) = '' THEN 'empty' END AS error FROM (SELECT l_partkey, CASE WHEN l_linenumber = 3 THEN ' ' ELSE l_returnflag END AS t, count(*) OVER (PARTITION BY l_partkey) AS c FROM lineitem)")
def pool_validation(spark, d):
    rows = V.table(spark, d, "lineitem").selectExpr("l_partkey AS id", "CASE WHEN l_linenumber = 3 THEN ' ' ELSE l_returnflag END AS structure")
    return features.validate_pool(rows).select("id", "error")


CELLS = "(SELECT vec_id, unnest(range(len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
HOLES = f"(SELECT vec_id, i, CASE WHEN (vec_id * 31 + i * 17) % 13 = 0 THEN NULL ELSE x END AS x FROM {CELLS})"


def holes(spark, d):
    x = "transform(embedding, (x, i) -> if((vec_id * 31 + i * 17) % 13 = 0, double('nan'), cast(x AS double)))"
    return V.table(spark, d, "embeddings").selectExpr("vec_id AS id", f"{x} AS features")


def spread(rows):
    return rows.select(F.col("id").alias("vec_id"), F.posexplode("features").alias("i", "x")).select("vec_id", "i", F.round("x", 5).alias("x"))


@add("impute_median", f"SELECT vec_id, i, round(coalesce(x, m), 5) AS x FROM {HOLES} JOIN (SELECT i, median(x) AS m FROM {HOLES} GROUP BY i) USING (i)")
def impute_median(spark, d):
    rows = holes(spark, d)
    return spread(transforms.Impute().fit(rows).transform(rows))


@add("standard_scale", f"SELECT vec_id, i, round((x - m) / s, 5) AS x FROM {CELLS} JOIN (SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS s FROM {CELLS} GROUP BY i) USING (i)")
def standard_scale(spark, d):
    rows = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return spread(transforms.Scale().fit(rows).transform(rows))


@add("variance_mask_applied", f"SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY i)::INT - 1 AS i, round(x, 5) AS x FROM {CELLS} WHERE i % 8 <> 0")
def variance_mask_applied(spark, d):
    """Every eighth column is set to a constant first; the mask is fitted on half of the rows and used on all."""
    rows = V.table(spark, d, "embeddings").selectExpr("vec_id AS id", "transform(embedding, (x, i) -> if(i % 8 = 0, 1D, cast(x AS double))) AS features")
    return spread(transforms.VarianceMask().fit(rows.where("id % 2 = 0")).transform(rows))


E = "(SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


@add("ensemble_members", f"SELECT vec_id, round(list_avg(e), 6) AS mean, round(list_median(e), 6) AS median, round(list_stddev_pop(e), 6) AS std, round(list_median(list_transform(e, lambda x: abs(x - list_median(e)))), 6) AS mad, round((list_aggregate(e, 'quantile_cont', 0.75) - list_aggregate(e, 'quantile_cont', 0.25)) / 2, 6) AS quantile, round(list_sum(list_transform(e, lambda x, i: x * i)) / (len(e) * (len(e) + 1) / 2), 6) AS weighted FROM {E}")
def ensemble_members(spark, d):
    """All aggregations of members' predictions; weights are 1, 2, 3 and so on."""
    import numpy as np
    import pandas as pd

    from ..ship import ship

    ship(spark)

    def run(batches):
        for batch in batches:
            m = np.stack([np.asarray(v, float) for v in batch["embedding"]]).T if len(batch) else np.zeros((1, 0))
            w = list(range(1, len(m) + 1))
            out = {n: learners.together(m, n) for n in ("mean", "median")} | {n: learners.disagreement(m, n) for n in ("std", "mad", "quantile")} | {"weighted": learners.together(m, "weighted", w)}
            yield pd.DataFrame({"vec_id": batch["vec_id"], **out})

    names = ("mean", "median", "std", "mad", "quantile", "weighted")
    out = V.table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, " + ", ".join(f"{n} double" for n in names))
    return out.select("vec_id", *(F.round(n, 6).alias(n) for n in names))


def labeled(spark, d):
    return V.pred(spark, d).where("id % 10 < 2").selectExpr("id", "target", "array(prediction) AS features")


def pool_rows(spark, d):
    return V.pred(spark, d).where("id % 10 >= 2").selectExpr("id", "array(prediction, uncertainty, cast(id % 97 AS double)) AS features")


def wide_labeled(spark, d):
    return V.pred(spark, d).where("id % 10 < 2").selectExpr("id", "target", "array(prediction, uncertainty, cast(id % 97 AS double)) AS features")


@add("learner_lr", "WITH t AS (SELECT prediction AS x, target AS y FROM pred WHERE id % 10 < 2), m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(y) AS vy, count(*) AS n FROM t), f AS (SELECT *, n * c / sx / (n + 0.1) AS w FROM m), g AS (SELECT *, greatest(0, n * vy - 2 * w * n * c / sx + w * w * n) / (n - 2) AS noise FROM f) SELECT id, round(my + w * (prediction - mx) / sx, 3) AS prediction, round(sqrt(noise * (1 + ((prediction - mx) / sx) ** 2 / (n + 0.1))), 3) AS uncertainty FROM pred, g WHERE id % 10 >= 2")
def learner_lr(spark, d):
    model = learners.learner("lr").fit(labeled(spark, d))
    rows = V.pred(spark, d).where("id % 10 >= 2").selectExpr("id", "array(prediction) AS features")
    return model.predict(rows).select("id", F.round("prediction", 3).alias("prediction"), F.round("uncertainty", 3).alias("uncertainty"))


def fitted(name: str, **settings: object):
    def query(spark, d):
        return learners.learner(name, **settings).fit(wide_labeled(spark, d)).predict(pool_rows(spark, d))

    return query


# Fitted models have no SQL; tests/test_learners.py holds their errors and uncertainties against plain computations.
add("learner_rf")(fitted("rf", trees=30, depth=8))
add("learner_dt")(fitted("dt"))
add("learner_xgb")(fitted("xgb", trees=15, depth=4))
add("learner_gp")(fitted("gp", most=1000))
add("learner_mlp")(fitted("mlp", layers=(32, 16), epochs=15, most=5000))
add("learner_mc_dropout")(fitted("mc_dropout", layers=(32, 16), passes=30, epochs=15, most=5000))
add("learner_dt_ensemble")(fitted("dt_ensemble"))
add("learner_lr_ensemble")(fitted("lr_ensemble"))

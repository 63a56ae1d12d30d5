import numpy as np
import pytest
from pyspark.sql import functions as F

from prospectra.errors import ConfigError, LearnerError
from prospectra.operators import learners as L


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4))
    return x, 3 * x[:, 0] - 2 * x[:, 1] + 0.5 * x[:, 2] ** 2 + rng.normal(size=400) * 0.1


@pytest.fixture(scope="module")
def table(spark, data):
    x, y = data
    return spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, features array<double>, target double").repartition(3).cache()


def predicted(model, table, **how):
    return {r["id"]: r for r in model.predict(table, **how).collect()}


def test_trees_agree_with_spark(table, data):
    from pyspark.ml.regression import RandomForestRegressor

    rows = L._vectors(table, "features", "target")
    fitted = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=7, maxDepth=5, seed=3).fit(rows)
    nodes = L.arrays_of(fitted, table.sparkSession)
    x = data[0]
    ours, _ = L.Trees(nodes, np.full(7, 1 / 7), "spread").predict_matrix(x)
    from pyspark.ml.linalg import Vectors

    assert np.allclose(ours, [fitted.predict(Vectors.dense(r)) for r in x])
    every = np.stack([L.Trees([n], np.ones(1), None).predict_matrix(x)[0] for n in nodes])
    assert np.allclose(L.Trees(nodes, np.full(7, 1 / 7), "spread").predict_matrix(x)[1], every.std(0))


def test_ridge_against_numpy(table, data):
    x, y = data
    model = L.learner("lr", alpha=0.1).fit(table)
    z = (x - x.mean(0)) / x.std(0)
    a = z.T @ z + 0.1 * np.eye(4)
    w = np.linalg.solve(a, z.T @ (y - y.mean()))
    got = predicted(model, table)
    assert np.allclose([got[i]["prediction"] for i in range(400)], z @ w + y.mean())
    noise = np.square(y - y.mean() - z @ w).sum() / (400 - 5)
    assert np.allclose([got[i]["uncertainty"] for i in range(400)], np.sqrt(noise * (1 + np.einsum("ij,jk,ik->i", z, np.linalg.inv(a), z))))


def test_gaussian_process_against_numpy(table, data):
    x, y = data
    model = L.learner("gp", kernel="rbf", most=400).fit(table)
    k = L.kernel_of(model.kernel, x, x)
    inverse = np.linalg.inv(k + (0.01 + 1e-8) * np.eye(400))
    got = predicted(model, table)
    assert np.allclose([got[i]["prediction"] for i in range(400)], k @ inverse @ (y - y.mean()) + y.mean(), atol=1e-5)
    assert np.allclose([got[i]["uncertainty"] for i in range(400)], np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", k, inverse, k), 1e-12)) * y.std(), atol=1e-4)
    binary = table.withColumn("features", F.transform("features", lambda v: (v > 0).cast("int")))
    assert L.learner("gp").fit(binary).kernel[0] == "tanimoto"


@pytest.mark.parametrize("name, settings, uncertain", [("rf", {"trees": 12, "depth": 6}, True), ("dt", {}, True), ("xgb", {"trees": 12}, False), ("mlp", {"layers": (32,), "epochs": 40}, False), ("mc_dropout", {"layers": (32,), "passes": 20, "epochs": 40, "drop": 0.05}, True), ("lr_ensemble", {}, True), ("dt_ensemble", {}, True)])
def test_learners_learn(table, data, name, settings, uncertain):
    model = L.learner(name, **settings).fit(table)
    got = predicted(model, table)
    p = np.array([got[i]["prediction"] for i in range(400)])
    assert np.square(p - data[1]).mean() < 0.35 * data[1].var()
    assert ("uncertainty" in got[0].asDict()) == uncertain
    if uncertain:
        s = np.array([got[i]["uncertainty"] for i in range(400)])
        assert (s >= 0).all() and s.max() > 0
        assert "uncertainty" not in predicted(model, table, uncertainty=False)[0].asDict()
    again = predicted(model, table.repartition(5))
    assert all(abs(again[i]["prediction"] - got[i]["prediction"]) < 1e-9 for i in got)


def test_ensembles_and_names(table):
    m = np.array([[1.0, 2], [2, 2], [9, 2]])
    assert list(L.together(m)) == [4, 2] and list(L.together(m, "median")) == [2, 2] and list(L.together(m, "weighted", [1, 0, 1])) == [5, 2]
    assert np.allclose(L.disagreement(m, "mad"), [1, 0]) and np.allclose(L.disagreement(m, "quantile"), [2, 0]) and np.allclose(L.disagreement(m), m.std(0))
    with pytest.raises(ConfigError):
        L.Ensemble([L.Ridge()], "weighted")
    with pytest.raises(ConfigError):
        L.learner("nothing")
    with pytest.raises(LearnerError):
        L.learner("chemprop")
    assert L.learner("gpu_gp").name == "gp"
    with pytest.raises(LearnerError):
        L.learner("lr").fit(table.where("false"))


def test_jackknife_against_numpy(spark):
    from prospectra.operators import calibration

    rng = np.random.default_rng(7)
    t, n = rng.normal(size=(30, 20)), rng.integers(0, 4, size=(20, 15))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(t)], "id long, members array<double>")
    cov = (n - 1.0).T @ (t - t.mean(1, keepdims=True)).T / 20
    raw = np.square(cov).sum(0)
    fixed = raw - 15 * t.var(1) / 20
    for r in calibration.jackknife(rows, n.tolist()).collect():
        assert abs(r["raw_variance"] - raw[r["id"]]) < 1e-9 and abs(r["corrected_variance"] - fixed[r["id"]]) < 1e-9 and abs(r["standard_error"] - max(fixed[r["id"]], 0) ** 0.5) < 1e-9

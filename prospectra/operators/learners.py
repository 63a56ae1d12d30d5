"""Learners: fit on labeled rows (features: array of numbers, target), predict mean and, where there is one, uncertainty.

Trees are fitted by Spark ML over all labeled rows, the linear model from one distributed Gram matrix. A fitted model is a set
of numpy arrays that goes with the tasks; prediction is one pass of Arrow batches over the pool. The Gaussian process and the
networks are fitted on the driver from at most `most` labeled rows, a documented bound.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, FitWarning, LearnerError
from ..functions import counter
from ..ship import ship
from . import order
from .neighbours import tanimoto_kernel
from .transforms import leverage


class Model:
    """predict_matrix gives means and uncertainties (None without any) of the rows of a matrix."""

    def predict_matrix(self, x: np.ndarray, uncertainty: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        raise NotImplementedError

    @property
    def uncertain(self) -> bool:
        return True

    def predict(self, rows: DataFrame, features: str = "features", key: str = "id", uncertainty: bool = True) -> DataFrame:
        """(key, prediction[, uncertainty]); the second column is only there if it is computed."""
        ship(rows.sparkSession)
        kind = rows.schema[key].dataType.simpleString()
        wants = uncertainty and self.uncertain

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                mean, std = self.predict_matrix(np.stack([np.asarray(v, float) for v in batch["v"]]), wants)
                out = {"k": batch["k"], "prediction": mean}
                yield pd.DataFrame(out | {"uncertainty": std} if wants else out)

        schema = f"k {kind}, prediction double" + (", uncertainty double" if wants else "")
        return rows.select(F.col(key).alias("k"), F.col(features).alias("v")).mapInPandas(run, schema).withColumnRenamed("k", key)


class Learner:
    """fit(rows) gives a Model."""

    name = ""

    def fit(self, rows: DataFrame, features: str = "features", target: str = "target", key: str = "id") -> Model:
        raise NotImplementedError


def bounded(rows: DataFrame, features: str, target: str, key: str, most: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Features and targets of at most `most` rows, those of smallest counter hash."""
    some = order.best(rows.select(key, features, target).withColumn("__u", -counter.uniform(f"fit-{seed}", F.col(key))), "__u", most, key).drop("__u")
    got = some.orderBy(key).toPandas()
    if not len(got):
        raise LearnerError("there are no labeled rows")
    return np.stack([np.asarray(v, float) for v in got[features]]), got[target].to_numpy(float)


# Trees

class Trees(Model):
    """Weighted trees as arrays. how: 'spread' (deviation over trees), 'leaf' (root of the leaf's variance), or none."""

    def __init__(self, nodes: list[dict[str, np.ndarray]], weights: np.ndarray, how: str | None):
        self.nodes, self.weights, self.how = nodes, weights, how

    @property
    def uncertain(self) -> bool:
        return self.how is not None

    def leaves(self, x: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        while len(live):
            here = at[live]
            inner = tree["left"][here] >= 0
            live, here = live[inner], here[inner]
            left = x[live, tree["feature"][here]] <= tree["threshold"][here]
            at[live] = np.where(left, tree["left"][here], tree["right"][here])
        return at

    def predict_matrix(self, x, uncertainty=True):
        if self.how == "leaf":
            tree = self.nodes[0]
            at = self.leaves(x, tree)
            return tree["value"][at], np.sqrt(np.maximum(tree["impurity"][at], 0)) if uncertainty else None
        total, square = np.zeros(len(x)), np.zeros(len(x))
        for tree, w in zip(self.nodes, self.weights, strict=True):
            p = tree["value"][self.leaves(x, tree)]
            total += w * p
            square += w * p * p
        if self.how is None:
            return total, None
        return total, np.sqrt(np.maximum(square - total * total, 0)) if uncertainty else None


def arrays_of(model, spark) -> list[dict[str, np.ndarray]]:
    """The trees of a fitted Spark ML model, by way of its saved form."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="prospectra-")
    path = f"{folder}/model-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        data = spark.read.parquet(f"{path}/data")
        data = data.select("treeID", "nodeData.*") if "nodeData" in data.columns else data.withColumn("treeID", F.lit(0))
        flat = data.select("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"))
        table = flat.orderBy("treeID", "id").toPandas()  # as large as the model
    finally:
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    out = []
    for _, t in table.groupby("treeID", sort=True):
        place = np.full(int(t["id"].max()) + 1, -1)
        place[t["id"]] = np.arange(len(t))
        child = lambda c: np.where(t[c] >= 0, place[np.maximum(t[c], 0)], -1)  # noqa: B023, E731
        out.append({"left": child("leftChild"), "right": child("rightChild"), "feature": np.maximum(t["feature"].to_numpy(), 0), "threshold": t["threshold"].fillna(0).to_numpy(float), "value": t["prediction"].to_numpy(float), "impurity": np.array([max(0.0, s[2] / s[0] - (s[1] / s[0]) ** 2) for s in t["impurityStats"]])})  # count, sum, sum of squares
    return out


def _vectors(rows: DataFrame, features: str, target: str) -> DataFrame:
    # A fixed order of rows, so that the samples of one seed are the same for any input partitioning.
    return rows.select(array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("x"), F.col(target).cast("double").alias("y")).where("y IS NOT NULL")


class Forest(Learner):
    """Random forest: bootstrap, a third or the root of the features a split; uncertainty is the deviation over trees."""

    name = "rf"

    def __init__(self, trees: int = 100, depth: int = 12, leaf: int = 1, features: str = "sqrt", seed: int = 42):
        self.trees, self.depth, self.leaf, self.features, self.seed = trees, depth, leaf, features, seed

    def fit(self, rows, features="features", target="target", key="id"):
        from pyspark.ml.regression import RandomForestRegressor

        fitted = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=self.trees, maxDepth=self.depth, minInstancesPerNode=self.leaf, featureSubsetStrategy=self.features, seed=self.seed).fit(_vectors(rows, features, target))
        nodes = arrays_of(fitted, rows.sparkSession)
        return Trees(nodes, np.full(len(nodes), 1 / len(nodes)), "spread")


class Tree(Learner):
    """One tree; uncertainty is the root of the leaf's variance."""

    name = "dt"

    def __init__(self, depth: int = 10, leaf: int = 5, seed: int = 42):
        self.depth, self.leaf, self.seed = depth, leaf, seed

    def fit(self, rows, features="features", target="target", key="id"):
        from pyspark.ml.regression import DecisionTreeRegressor

        fitted = DecisionTreeRegressor(featuresCol="x", labelCol="y", maxDepth=self.depth, minInstancesPerNode=self.leaf, seed=self.seed).fit(_vectors(rows, features, target))
        return Trees(arrays_of(fitted, rows.sparkSession), np.ones(1), "leaf")


class Boosted(Learner):
    """Gradient-boosted trees; no uncertainty."""

    name = "xgb"

    def __init__(self, trees: int = 50, depth: int = 5, step: float = 0.1, seed: int = 42):
        self.trees, self.depth, self.step, self.seed = trees, depth, step, seed

    def fit(self, rows, features="features", target="target", key="id"):
        from pyspark.ml.regression import GBTRegressor

        fitted = GBTRegressor(featuresCol="x", labelCol="y", maxIter=self.trees, maxDepth=self.depth, stepSize=self.step, seed=self.seed).fit(_vectors(rows, features, target))
        return Trees(arrays_of(fitted, rows.sparkSession), np.array(fitted.treeWeights), None)


# Linear model

class Linear(Model):
    def __init__(self, mean, std, weights, base, noise, lower):
        self.mean, self.std, self.weights, self.base, self.noise, self.lower = mean, std, weights, base, noise, lower

    def predict_matrix(self, x, uncertainty=True):
        z = (x - self.mean) / self.std
        return z @ self.weights + self.base, np.sqrt(self.noise * (1 + leverage(z, self.lower))) if uncertainty else None


def gram(rows: DataFrame, column: str = "v") -> np.ndarray:
    """The products of all columns of an array column with each other: a matrix a task, added up in 16 tasks, then in one."""
    ship(rows.sparkSession)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                x = np.stack([np.asarray(v, float) for v in batch[column]])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"g": [total.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for g in batch["g"]:
                total = np.frombuffer(g) if total is None else total + np.frombuffer(g)
        if total is not None:
            yield pd.DataFrame({"g": [total.tobytes()]})

    parts = rows.select(column).mapInPandas(products, "g binary").repartition(16).mapInPandas(add, "g binary")
    out = np.frombuffer(parts.repartition(1).mapInPandas(add, "g binary").first()["g"])
    size = round(len(out) ** 0.5)
    return out.reshape(size, size)


class Ridge(Learner):
    """Ridge regression on scaled columns, all from one Gram matrix of (features, target, 1) that tasks add up; uncertainty from leverage."""

    name = "lr"

    def __init__(self, alpha: float = 0.1):
        if alpha < 0:
            raise ConfigError("alpha must not be negative")
        self.alpha = alpha

    def fit(self, rows, features="features", target="target", key="id"):
        full = rows.where(F.col(target).isNotNull()).select(F.concat(F.transform(features, lambda x: x.cast("double")), F.array(F.col(target).cast("double"), F.lit(1.0))).alias("v"))
        if not full.limit(1).count():
            raise LearnerError("there are no labeled rows")
        g = gram(full)
        n, sums = g[-1, -1], g[-1, :-1]
        mean = sums / n
        cov = g[:-1, :-1] / n - np.outer(mean, mean)
        std = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
        std = np.where(std > 1e-12 * (1 + np.abs(mean[:-1])), std, 1.0)
        xx = n * cov[:-1, :-1] / np.outer(std, std) + self.alpha * np.eye(len(std))
        xy = n * cov[:-1, -1] / std
        lower = np.linalg.cholesky(xx + 1e-12 * np.eye(len(std)))
        w = np.linalg.solve(lower.T, np.linalg.solve(lower, xy))
        rest = n * cov[-1, -1] - 2 * w @ xy + w @ (xx - self.alpha * np.eye(len(std))) @ w
        return Linear(mean[:-1], std, w, mean[-1], max(rest, 0.0) / max(n - len(std) - 1, 1), lower)


# Gaussian process

class Process(Model):
    def __init__(self, x, y_mean, y_std, lower, alpha, kernel, noise):
        self.x, self.y_mean, self.y_std, self.lower, self.alpha, self.kernel, self.noise = x, y_mean, y_std, lower, alpha, kernel, noise

    def predict_matrix(self, x, uncertainty=True):
        k = kernel_of(self.kernel, x, self.x)
        mean = k @ self.alpha * self.y_std + self.y_mean
        if not uncertainty:
            return mean, None
        v = np.linalg.solve(self.lower, k.T)
        own = kernel_of(self.kernel, x[:1], x[:1])[0, 0]
        return mean, np.sqrt(np.maximum(own - np.square(v).sum(0), 1e-12)) * self.y_std


def kernel_of(kind: tuple[str, float], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    name, length = kind
    if name == "tanimoto":
        return tanimoto_kernel(x, y)
    d = np.square(x).sum(1)[:, None] + np.square(y).sum(1)[None, :] - 2 * x @ y.T
    return np.exp(-np.maximum(d, 0) / (2 * length * length))


class Gaussian(Learner):
    """Exact Gaussian process on at most `most` rows: Tanimoto kernel for 0/1 features, else squared exponential with the median distance as length."""

    name = "gp"

    def __init__(self, kernel: str = "auto", noise: float = 0.01, most: int = 5000):
        if kernel not in ("auto", "tanimoto", "rbf"):
            raise ConfigError(f"unknown kernel {kernel!r}")
        self.kernel, self.noise, self.most = kernel, noise, most

    def fit(self, rows, features="features", target="target", key="id"):
        x, y = bounded(rows.where(F.col(target).isNotNull()), features, target, key, self.most)
        binary = bool(np.isin(x, (0, 1)).all())
        name = ("tanimoto" if binary else "rbf") if self.kernel == "auto" else self.kernel
        some = x[:: max(1, len(x) // 500)]
        d = np.sqrt(np.maximum(np.square(some).sum(1)[:, None] + np.square(some).sum(1)[None, :] - 2 * some @ some.T, 0))
        kind = (name, float(np.median(d[d > 0])) if (d > 0).any() else 1.0)
        scale = y.std() or 1.0
        lower = np.linalg.cholesky(kernel_of(kind, x, x) + (self.noise + 1e-8) * np.eye(len(x)))
        alpha = np.linalg.solve(lower.T, np.linalg.solve(lower, (y - y.mean()) / scale))
        return Process(x, y.mean(), scale, lower, alpha, kind, self.noise)


# Networks

class Network(Model):
    def __init__(self, layers, mean, std, y_mean, y_std, drop, passes, seed):
        self.layers, self.mean, self.std, self.y_mean, self.y_std = layers, mean, std, y_mean, y_std
        self.drop, self.passes, self.seed = drop, passes, seed

    @property
    def uncertain(self) -> bool:
        return self.passes > 0

    def forward(self, z: np.ndarray, rng=None) -> np.ndarray:
        for i, (w, b) in enumerate(self.layers):
            z = z @ w + b
            if i < len(self.layers) - 1:
                z = np.maximum(z, 0)
                if rng is not None:
                    # One mask of units a pass, so that a row's result doesn't depend on its batch.
                    z = z * (rng.random(z.shape[1]) >= self.drop) / (1 - self.drop)
        return z[:, 0]

    def predict_matrix(self, x, uncertainty=True):
        z = (x - self.mean) / self.std
        if not self.passes or not uncertainty:
            return self.forward(z) * self.y_std + self.y_mean, None
        every = np.stack([self.forward(z, np.random.default_rng([self.seed, i])) for i in range(self.passes)])
        return every.mean(0) * self.y_std + self.y_mean, every.std(0) * self.y_std


class Perceptron(Learner):
    """A network with rectified layers, fitted by Adam on at most `most` rows; with passes, dropout stays on in prediction and gives uncertainty."""

    name = "mlp"

    def __init__(self, layers: tuple[int, ...] = (512, 256, 128), drop: float = 0.0, passes: int = 0, epochs: int = 60, rate: float = 1e-3, batch: int = 64, most: int = 50_000, seed: int = 42):
        self.layers, self.drop, self.passes, self.epochs, self.rate, self.batch, self.most, self.seed = layers, drop, passes, epochs, rate, batch, most, seed

    def fit(self, rows, features="features", target="target", key="id"):
        x, y = bounded(rows.where(F.col(target).isNotNull()), features, target, key, self.most)
        mean, std = x.mean(0), x.std(0)
        std = np.where(std > 1e-10, std, 1.0)
        y_mean, y_std = y.mean(), y.std() or 1.0
        z, t = (x - mean) / std, (y - y_mean) / y_std
        rng = np.random.default_rng(self.seed)
        sizes = [z.shape[1], *self.layers, 1]
        params = [p for a, b in zip(sizes, sizes[1:]) for p in (rng.normal(size=(a, b)) * np.sqrt(2 / a), np.zeros(b))]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, losses = 0, []
        for _ in range(self.epochs):
            loss = 0.0
            for part in np.array_split(rng.permutation(len(z)), max(1, len(z) // self.batch)):
                inputs, kept, h = [], [], z[part]
                for i in range(0, len(params), 2):
                    inputs.append(h)
                    h = h @ params[i] + params[i + 1]
                    if i < len(params) - 2:
                        keep = (h > 0) * ((rng.random(h.shape) >= self.drop) / (1 - self.drop) if self.drop else 1.0)
                        kept.append(keep)
                        h = h * keep
                gap = h[:, 0] - t[part]
                loss += float(np.square(gap).sum())
                d = (2 * gap / len(part))[:, None]
                step += 1
                for i in range(len(params) - 2, -1, -2):
                    grads = (inputs[i // 2].T @ d, d.sum(0))
                    if i:
                        d = d @ params[i].T * kept[i // 2 - 1]
                    for j, g in zip((i, i + 1), grads, strict=True):
                        m[j] = 0.9 * m[j] + 0.1 * g
                        v[j] = 0.999 * v[j] + 0.001 * g * g
                        params[j] = params[j] - self.rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
            losses.append(loss / len(z))
        if len(losses) > 4 and losses[-1] > losses[0]:
            warnings.warn("the network's error didn't fall", FitWarning, stacklevel=2)
        return Network(list(zip(params[::2], params[1::2], strict=True)), mean, std, y_mean, y_std, self.drop, self.passes, self.seed)


class Dropout(Perceptron):
    name = "mc_dropout"

    def __init__(self, layers: tuple[int, ...] = (256, 128), drop: float = 0.2, passes: int = 100, **others):
        super().__init__(layers, drop, passes, **others)


# Ensembles

def together(members: np.ndarray, how: str = "mean", weights: list[float] | None = None) -> np.ndarray:
    """Members' predictions (member, row) as one: mean, median or weighted."""
    if how == "mean":
        return members.mean(0)
    if how == "median":
        return np.median(members, 0)
    if how == "weighted":
        w = np.asarray(weights, float)
        return w @ members / w.sum()
    raise ConfigError(f"unknown aggregation {how!r}")


def disagreement(members: np.ndarray, how: str = "std") -> np.ndarray:
    """How far members differ: std (population), mad, or quantile (half the middle range)."""
    if how == "std":
        return members.std(0)
    if how == "mad":
        return np.median(np.abs(members - np.median(members, 0)), 0)
    if how == "quantile":
        low, high = np.quantile(members, (0.25, 0.75), axis=0)
        return (high - low) / 2
    raise ConfigError(f"unknown uncertainty {how!r}")


class Several(Model):
    def __init__(self, members: list[Model], how: str, spread: str, weights: list[float] | None):
        self.members, self.how, self.spread, self.weights = members, how, spread, weights

    def predict_matrix(self, x, uncertainty=True):
        every = np.stack([m.predict_matrix(x, False)[0] for m in self.members])
        return together(every, self.how, self.weights), disagreement(every, self.spread) if uncertainty else None


class Ensemble(Learner):
    name = "ensemble"

    def __init__(self, members: list[Learner], how: str = "mean", spread: str = "std", weights: list[float] | None = None):
        if not members:
            raise ConfigError("an ensemble needs members")
        if how == "weighted" and (weights is None or len(weights) != len(members)):
            raise ConfigError("weights must be as many as members")
        together(np.zeros((len(members), 1)), how, weights)
        disagreement(np.zeros((2, 1)), spread)
        self.members, self.how, self.spread, self.weights = members, how, spread, weights

    def fit(self, rows, features="features", target="target", key="id"):
        return Several([m.fit(rows, features, target, key) for m in self.members], self.how, self.spread, self.weights)


SEEDS = (0, 81, 314)
LEARNERS = {
    "rf": Forest, "dt": Tree, "lr": Ridge, "gp": Gaussian, "xgb": Boosted, "mlp": Perceptron, "mc_dropout": Dropout,
    "rf_ensemble": lambda seed=42, **s: Ensemble([Forest(seed=seed + x, **s) for x in SEEDS]),
    "dt_ensemble": lambda seed=42, **s: Ensemble([Tree(depth=d, seed=seed, **s) for d in (5, 10, 15)]),
    "lr_ensemble": lambda **s: Ensemble([Ridge(a, **s) for a in (0.1, 1.0, 10.0)]),
    "xgb_ensemble": lambda seed=42, **s: Ensemble([Boosted(seed=seed + x, **s) for x in SEEDS]),
    "mixed_ensemble": lambda seed=42: Ensemble([Forest(seed=seed), Ridge(), Boosted(seed=seed)]),
}
#: Names for processors that Spark doesn't use: the same model on this one.
TWINS = {"rf_fil": "rf", "ridge_cuml": "lr", "gpu_gp": "gp", "svgp": "gp"}
#: Message-passing networks need a toolkit; a plug-in may register them.
TOOLKIT = ("fastprop", "chemprop", "fastprop_ensemble", "chemprop_ensemble")


def register(name: str, make) -> None:
    LEARNERS[name] = make


def learner(name: str | Learner, **settings: object) -> Learner:
    if isinstance(name, Learner):
        return name
    name = TWINS.get(name, name)
    if name in LEARNERS:
        return LEARNERS[name](**settings)
    if name in TOOLKIT:
        raise LearnerError(f"{name} needs a toolkit: give it to register()")
    raise ConfigError(f"unknown learner {name!r}; there are {', '.join(LEARNERS)}")

"""Operator 3, quality classifier: a generalised additive model with pairwise interactions.

Features are counted from the text by Spark's own functions. The model has a lookup table over bins for each feature and
for some pairs of features; cyclic boosting of shallow trees on binned, labelled rows fills the tables: each round takes
one feature after the other, fits a tree of few leaves to the gradient of the logistic loss and adds its leaves to that
feature's table. Scores are sums of table entries, looked up for whole Arrow batches by numpy, through a sigmoid.

The fit sees a bounded sample of labelled rows (FIT_ROWS, the smallest hashes of their keys); every row is scored.
Labels, languages, sources and keys are no inputs of a score. Null and empty texts are scored as texts without words.
Contradicting labels of a key all count. Without labelled rows every score is 0.5. Rows with the same key are scored each by
its text. Very long texts are read whole by the functions that count. An empty table gives an empty result. Other columns
come out as they went in; one named score or predicted raises an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows that the fit takes at most.
FIT_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = ["log_words", "word_length", "symbols", "capitals", "digits", "marks", "ends", "repeated_lines", "distinct_words", "distinct_pairs", "line_words"]


def features(text: Column) -> dict[str, Column]:
    """Ratios over the whole text; __w (words) must be a column."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    w = F.greatest(F.size("__w"), F.lit(1)).cast("double")
    less = lambda signs: (F.length(text) - F.length(F.translate(text, signs, ""))) / n
    lines = F.greatest(F.size("__l"), F.lit(1)).cast("double")
    return {
        "log_words": F.log1p(F.size("__w").cast("double")),
        "word_length": n / w,
        "symbols": less("#*$%&|<>{}[]\\^~=+@_"),
        "capitals": (F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}+", ""))) / n,
        "digits": less("0123456789"),
        "marks": less("!?"),
        "ends": less(".,;:"),
        "repeated_lines": 1 - F.size(F.array_distinct("__l")) / lines,
        "distinct_words": F.size(F.array_distinct("__w")) / w,
        "distinct_pairs": F.size(F.array_distinct("__p")) / w,
        "line_words": F.log1p(w / lines),
    }


def featured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the array __x of FEATURES."""
    t = C.clean(text)
    out = docs.withColumn("__w", F.transform(C.words(t), lambda x: F.xxhash64(x))).withColumn("__l", F.split(t, "\n"))
    out = out.withColumn("__p", F.zip_with("__w", F.slice("__w", 2, F.greatest(F.size("__w"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    got = features(t)
    return out.withColumn("__x", F.array(*(F.coalesce(got[f].cast("double"), F.lit(0.0)) for f in FEATURES))).drop("__w", "__l", "__p")


@dataclass
class PairwiseAdditiveModel:
    """Boosted lookup tables: `edges` of each feature's bins, one table a feature, one a pair of features."""

    rounds: int = 300
    pair_rounds: int = 100
    pairs: int = 5
    bins: int = 64
    pair_bins: int = 8
    leaves: int = 3
    rate: float = 0.1
    least: float = 2.0
    base: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pair_edges: list = field(default_factory=list)
    chosen: list = field(default_factory=list)
    pair_tables: list = field(default_factory=list)

    @staticmethod
    def _edges(x: np.ndarray, bins: int) -> np.ndarray:
        q = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)
        return q

    @staticmethod
    def _cuts(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
        """Greedy best-first tree over ordered bins: the leaf value for each bin."""
        out, spans = np.zeros(len(g)), [(0, len(g))]

        def best(a: int, b: int) -> tuple[float, int]:
            G, H = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            if b - a < 2:
                return 0.0, a
            l, r = G[:-1] ** 2 / (H[:-1] + 1), (G[-1] - G[:-1]) ** 2 / (H[-1] - H[:-1] + 1)
            gain = np.where((H[:-1] >= least) & (H[-1] - H[:-1] >= least), l + r - G[-1] ** 2 / (H[-1] + 1), -1)
            k = int(np.argmax(gain))
            return float(gain[k]), a + k + 1

        while len(spans) < leaves:
            gain, cut, at = max((*best(*s), i) for i, s in enumerate(spans))
            if gain <= 1e-9:
                break
            a, b = spans.pop(at)
            spans += [(a, cut), (cut, b)]
        for a, b in spans:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseAdditiveModel:
        n, k = x.shape
        self.edges = [self._edges(x[:, j], self.bins) for j in range(k)]
        self.pair_edges = [self._edges(x[:, j], self.pair_bins) for j in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if not n:
            return self
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        score = np.full(n, self.base)
        prob = lambda: 1 / (1 + np.exp(-score))
        for _ in range(self.rounds):
            for j in range(k):
                q = prob()
                size = len(self.tables[j])
                step = self.rate * self._cuts(np.bincount(at[j], y - q, size), np.bincount(at[j], q * (1 - q), size), self.leaves, self.least)
                self.tables[j] += step
                score += step[at[j]]
        coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]

        def grid(a: int, b: int) -> tuple[np.ndarray, int]:
            wide = len(self.pair_edges[b]) + 1
            return coarse[a] * wide + coarse[b], (len(self.pair_edges[a]) + 1) * wide

        def gain(a: int, b: int) -> float:  # what the best quadrants of the residual explain
            q = prob()
            cell, size = grid(a, b)
            g, h = (np.bincount(cell, v, size).reshape(len(self.pair_edges[a]) + 1, -1).cumsum(0).cumsum(1) for v in (y - q, q * (1 - q)))
            best = 0.0
            for i in range(g.shape[0] - 1):
                for j in range(g.shape[1] - 1):
                    quads = [(m[i, j], m[i, -1] - m[i, j], m[-1, j] - m[i, j], m[-1, -1] - m[i, -1] - m[-1, j] + m[i, j]) for m in (g, h)]
                    best = max(best, sum(u * u / (v + 1) for u, v in zip(*quads, strict=True)))
            return best

        ranked = sorted(((gain(a, b), a, b) for a in range(k) for b in range(a)), reverse=True)
        self.chosen = [(a, b) for _, a, b in ranked[: self.pairs]]
        self.pair_tables = [np.zeros(grid(a, b)[1]) for a, b in self.chosen]
        for _ in range(self.pair_rounds):
            for t, (a, b) in zip(self.pair_tables, self.chosen, strict=True):
                q = prob()
                cell, size = grid(a, b)
                g, h = np.bincount(cell, y - q, size), np.bincount(cell, q * (1 - q), size)
                wide = len(self.pair_edges[b]) + 1
                rows = self._cuts(g.reshape(-1, wide).sum(1), h.reshape(-1, wide).sum(1), 2, self.least)
                step = np.zeros(size)
                for value in np.unique(rows):  # the second level of the tree: each side of the first cut is cut by the other feature
                    side = np.repeat(rows == value, wide)
                    cols = self._cuts(np.where(side, g, 0).reshape(-1, wide).sum(0), np.where(side, h, 0).reshape(-1, wide).sum(0), 2, self.least)
                    step += np.where(side, np.tile(cols, size // wide), 0)
                t += self.rate * step
                score += self.rate * step[cell]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            score += t[np.searchsorted(e, x[:, j], side="right")]
        coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
        for (a, b), t in zip(self.chosen, self.pair_tables, strict=True):
            score += t[coarse[a] * (len(self.pair_edges[b]) + 1) + coarse[b]]
        return 1 / (1 + np.exp(-score))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = FIT_ROWS) -> PairwiseAdditiveModel:
    """Fits on at most so many labelled rows: of the keys with the smallest hashes."""
    picked = labels.select(F.col(key).alias("__key"), F.col(label).cast("double").alias("__y")).dropna().distinct().orderBy(F.xxhash64("__key"), "__key", "__y").limit(rows)
    got = featured(docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(picked), "__key")).select("__key", "__y", "__x")
    got = got.orderBy(F.xxhash64("__key"), "__key").limit(2 * rows).toPandas()
    x = np.array(got["__x"].tolist(), float).reshape(len(got), len(FEATURES))
    order = np.lexsort((got["__y"].to_numpy(), got["__key"].to_numpy())) if len(got) else slice(0)
    return PairwiseAdditiveModel().fit(x[order], got["__y"].to_numpy(float)[order])


def classify(docs: DataFrame, model: PairwiseAdditiveModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs with score and predicted."""
    C.ship(docs.sparkSession)
    C.refuse(docs, "score", "predicted")

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    out = featured(docs, text).withColumn("score", score("__x")).drop("__x")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

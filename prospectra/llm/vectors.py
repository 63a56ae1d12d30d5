"""Operator 10, embedding near-dedup: product quantisation over a coarse inverted index, exact cosine rerank.

Vectors are scaled to length 1 in double precision; equal ones become one vector with a weight. Coarse centroids and the
codebooks of the residuals' subspaces are learnt on a bounded sample (FIT_ROWS); every vector is indexed in the list of its
nearest centroid and asks the lists of its PROBES nearest centroids. Within a list a query's table of subspace products
gives approximate products with all codes; each code's own error bounds what the approximation may miss, so that all
pairs that can reach the threshold are reranked by exact cosine and none below it is linked. A pair that both sides would
find is counted by one of them only. Lists are dealt in blocks of residents and of visitors: a task never holds more than
one block of each, whatever the list's size, and gives counts and a spanning forest of its links, never all pairs.

Null and zero vectors, and vectors with null or non-finite components or of another dimension than the first usual one,
link with nothing and are kept. Repeated rows of a vec_id with equal vectors count as vectors of their own. A
null key is replaced by a hash of the vector. Keys are integers. An empty table gives an empty result. Columns other than the
key and the vector take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

THRESHOLD = 0.9
FIT_ROWS = 20_000
PROBES = 12
LIST_ROWS = 200
MOST_LISTS = 8192
BLOCK = 1024
SUBSPACE = 4
CODES = 64


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest centroids, nearest first."""
    out = []
    for at in range(0, len(x), 4096):
        d = (c * c).sum(1) - 2 * x[at : at + 4096] @ c.T
        if k >= d.shape[1]:
            out.append(np.argsort(d, axis=1, kind="stable"))
        else:
            part = np.argpartition(d, k, axis=1)[:, :k]
            out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, min(k, len(c))), int)


@dataclass
class Index:
    coarse: np.ndarray
    books: list

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, seed: int = 7) -> Index:
        rng = np.random.default_rng(seed)
        coarse = kmeans(x, lists, 8, rng)
        rest = x - coarse[nearest(x, coarse, 1)[:, 0]]
        return cls(coarse, [kmeans(rest[:, a : a + SUBSPACE], CODES, 6, rng) for a in range(0, x.shape[1], SUBSPACE)])

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes by subspace, and the distance of each vector from what they stand for."""
        rest = x - self.coarse[home]
        codes = np.stack([nearest(rest[:, m * SUBSPACE : (m + 1) * SUBSPACE], b, 1)[:, 0] for m, b in enumerate(self.books)], 1)
        made = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        return codes, np.linalg.norm(rest - made, axis=1)

    def products(self, q: np.ndarray, codes: np.ndarray, home: int) -> np.ndarray:
        """Approximate products of queries with the coded vectors of a list: a table look-up for each subspace."""
        out = np.repeat((q @ self.coarse[home])[:, None], len(codes), 1)
        for m, b in enumerate(self.books):
            out += (q[:, m * SUBSPACE : (m + 1) * SUBSPACE] @ b.T)[:, codes[:, m]]
        return out


def matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a star forest with the components of the graph on n nodes with edges a-b: from each node to its component's smallest."""
    top = list(range(n))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            top[max(rx, ry)] = min(rx, ry)
    return [(x, r) for x in range(n) if (r := find(x)) != x]


def near_dedup(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """key, n_links, component_id, kept for every row of rows."""
    spark = rows.sparkSession
    C.ship(spark)

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for v in batch["v"]:
                try:
                    x = np.asarray(v, float) if v is not None else np.zeros(0)
                except (TypeError, ValueError):
                    x = np.zeros(0)
                with np.errstate(all="ignore"):
                    big = np.abs(x).max() if x.size else 0.0
                    x = x / big if big and np.isfinite(big) else x * np.nan
                    n = np.linalg.norm(x)
                out.append((x / n).astype("<f8").tobytes() if x.size and np.isfinite(n) and n > 0 else None)
            yield pd.DataFrame({"k": batch["k"], "x": out})

    scaled = rows.select(F.coalesce(F.col(key).cast("long"), F.xxhash64(vector)).alias("k"), F.col(vector).alias("v")).mapInPandas(C.lean(unit), "k long, x binary")
    scaled = C.written(scaled.withColumn("c", F.when(F.col("x").isNotNull(), F.md5("x"))), "unit", rows=rows.count())
    one = scaled.where("x is not null").groupBy("c").agg(F.min("k").alias("id"), F.count("*").alias("w"), F.first("x").alias("x"))
    one = C.written(one, "vector", rows=scaled.count())
    n = one.count()
    usual = one.groupBy(F.length("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return scaled.select(F.col("k").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"), F.lit(True).alias("kept"))
    dim = usual["n"] // 8
    lists = int(np.clip(n // LIST_ROWS, 4, MOST_LISTS))
    sample = one.where(F.length("x") == dim * 8).orderBy(F.xxhash64("c"), "c").limit(FIT_ROWS).select("x").toPandas()
    index = Index.fit(matrix(sample["x"]), lists)
    lists = len(index.coarse)
    probes = min(probes, lists)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = nearest(matrix(batch["x"]), index.coarse, probes).astype(np.int32)
            yield batch.assign(near=list(near))

    placed = one.where(F.length("x") == dim * 8).select("id", "w", "x").mapInPandas(C.lean(assign), "id long, w long, x binary, near array<int>")
    placed = C.written(placed, "placed", rows=n)
    sizes = placed.select(F.explode("near").alias("l"), (F.col("near")[0] == F.col("l")).cast("int").alias("home")).groupBy("l").agg(F.sum("home").alias("r"), F.count("*").alias("v")).collect()  # a row a list
    blocks = {r["l"]: (max(1, -(-r["r"] // BLOCK)), max(1, -(-r["v"] // BLOCK))) for r in sizes}
    rb = F.create_map(*[F.lit(x) for l, (r, _) in blocks.items() if r > 1 for x in (l, r)]) if any(r > 1 for r, _ in blocks.values()) else None
    vb = F.create_map(*[F.lit(x) for l, (_, v) in blocks.items() if v > 1 for x in (l, v)]) if any(v > 1 for _, v in blocks.values()) else None
    count = lambda table: F.coalesce(F.try_element_at(table, F.col("l")), F.lit(1)) if table is not None else F.lit(1)
    deal = lambda salt, table: F.pmod(F.xxhash64("id", F.lit(salt)), count(table)).cast("int")
    every = lambda table: F.explode(F.sequence(F.lit(0), count(table) - 1))
    home = placed.withColumn("l", F.col("near")[0])
    residents = home.withColumn("rb", deal(1, rb)).withColumn("vb", every(vb)).withColumn("visits", F.lit(False))
    visitors = placed.withColumn("l", F.explode("near")).withColumn("vb", deal(2, vb)).withColumn("rb", every(rb)).withColumn("visits", F.lit(True))

    def link(part: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ell = int(part[0])
        q, r = group[group["visits"]], group[~group["visits"]]
        ids = np.concatenate([q["id"].to_numpy(), r["id"].to_numpy()])
        if not len(q) or not len(r):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        order = np.argsort(r["id"].to_numpy(), kind="stable")
        r = r.iloc[order]
        qx, rx = matrix(q["x"]), matrix(r["x"])
        codes, off = index.encode(rx, np.full(len(rx), ell))
        close = index.products(qx, codes, ell) + off >= threshold - 1e-9  # no pair at the threshold lies outside
        a, b = np.nonzero(close)
        keep = (qx[a] * rx[b]).sum(1) >= threshold
        a, b = a[keep], b[keep]
        qi, ri = q["id"].to_numpy(), r["id"].to_numpy()
        keep = qi[a] != ri[b]
        a, b = a[keep], b[keep]
        # The resident would find the pair too if it asks the visitor's list: then the smaller id counts it.
        asks = np.stack(r["near"].to_numpy())
        homes = np.stack(q["near"].to_numpy())[:, 0]
        mutual = (asks[b] == homes[a][:, None]).any(1)
        keep = ~mutual | (qi[a] < ri[b])
        a, b = a[keep], b[keep]
        qw, rw = q["w"].to_numpy(), r["w"].to_numpy()
        ids = np.concatenate([qi, ri])
        links = np.concatenate([np.bincount(a, rw[b], len(qi)), np.bincount(b, qw[a], len(ri))]).astype(np.int64)
        some = np.flatnonzero(links)
        unique, number = np.unique(ids, return_inverse=True)
        tree = forest(number[a], number[b + len(qi)], len(unique))
        out = pd.DataFrame({"a": ids[some], "b": -1, "n": links[some]})
        return pd.concat([out, pd.DataFrame({"a": [unique[x] for x, _ in tree], "b": [unique[y] for _, y in tree], "n": 0})]).astype({"a": "int64", "b": "int64", "n": "int64"})

    both = residents.unionByName(visitors).select("l", "rb", "vb", "visits", "id", "w", "x", "near")
    found = C.written(both.groupBy("l", "rb", "vb").applyInPandas(link, "a long, b long, n long"), "links")
    links = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    groups = C.components(found.where("n = 0"))
    classes = one.select("c", "id", "w").join(links, "id", "left").join(groups, "id", "left")
    classes = classes.select("c", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = scaled.join(classes, "c", "left").select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "k").alias("component_id"))
    return out.withColumn("kept", F.col(key) == F.col("component_id"))

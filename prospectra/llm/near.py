"""Operator 8, n-gram Jaccard join: chosen-path join over sets of five-word shingles.

Texts with equal shingle sets form a class. In each of RUNS runs a class walks down a tree: at a node it picks one or two hash
functions (by the node's own hash) and goes to the children named by the shingle that each function puts first among its
shingles, so that two sets part at a step with probability 1 - Jaccard. Nodes that hold up to GROUP classes are buckets;
larger ones are split again, level by level, unless almost all of their classes go on together (DENSE: near copies of one
text, which no split parts) or DEPTH is reached. At DEPTH a run still finds a pair at the threshold with a probability of
about 0.4, so that RUNS runs find 0.99 of them; at the first level, where almost all sets are alone already, 1 - 1e-7.

The classes of a bucket are compared each with each: in one task, and in pairs of blocks where a bucket holds more than GROUP
classes or SHINGLES shingles. A pair that shares several buckets belongs to the first of them. Sketches of BINS bytes (one
permutation hashing) pass over pairs whose estimated similarity is below the threshold by SLACK, five standard deviations
(a pair at the threshold is lost with a probability of 1e-6); the rest are compared exactly, and texts travel only to
buckets that have such pairs of their own. A task gives each class's number of links and a spanning forest of its links,
never pairs. Links then join classes to components by shared tables; nothing is collected.

Words are [^\\x20\\x09-\\x0D]+, case kept. A text of one to four words is one shingle of all of them; null and blank texts have
no shingles, link with nothing and are classes of their own. Very long texts are sets as any other (their shingles must fit
in a task). Rows are told apart by key and text: repeated rows are copies of each other, rows with one key and several texts
are compared each by its text. A null key is replaced by a hash of the text. An empty table gives an empty result. Columns
other than the key and the text take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .vectors import forest

WORDS = 5
THRESHOLD = 0.8
RUNS = 10
#: Classes of a bucket that are compared at once, shingles of a block, levels, share of a node's classes in one child that ends its splitting.
GROUP = 512
SHINGLES = 400_000
DEPTH = 8
DENSE = 0.75
#: Words that a row carries to a comparison, rows that travel to a Python worker at a time.
PIECE = 1024
BATCH = 1000
#: Bytes of a sketch, and how far below the threshold an estimate may lie.
BINS, SLACK = 64, 0.25
_A, _B, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Distinct hashes of n-word windows, from the words' hashes; of all words if they are fewer."""
    w = words.view(np.uint64)
    if not len(w):
        return w
    size = min(n, len(w))
    out = np.full(len(w) - size + 1, np.uint64(size))
    for i in range(size):
        out = mix(out * _G + w[i : len(w) - size + 1 + i])
    return np.unique(out)


def sketch(tokens: np.ndarray) -> bytes:
    """Of the smallest shingle hash of each bin (its high bits) the low byte, from 1; 0 for an empty bin. tokens are sorted."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    at = np.searchsorted(tokens, edges)
    last = np.concatenate([at[1:], [len(tokens)]])
    out = np.zeros(BINS, np.uint8)
    some = at < last
    out[some] = tokens[at[some]] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def alike(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sketches may be of sets at the threshold."""
    same, either = (np.zeros((len(left), len(right)), np.uint8) for _ in range(2))
    for i in range(left.shape[1]):
        a, b = left[:, i][:, None], right[:, i][None, :]
        same += (a == b) & (a != 0)
        either += (a | b) != 0
    return same >= (threshold - SLACK) * either


def children(tokens: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that a set goes to from some nodes: place of the parent, and the child."""
    two = (mix(paths) >> np.uint64(62)) == 0
    owner = np.concatenate([np.arange(len(paths)), np.flatnonzero(two)])
    seeds = mix(np.concatenate([paths + _G, paths[two] + _G + _G]))
    short, first = tokens.astype(np.uint32), np.empty(len(seeds), np.uint64)
    step = max(1, 1_000_000 // len(tokens))
    for at in range(0, len(seeds), step):
        h = short[None, :] ^ (seeds[at : at + step, None] >> np.uint64(32)).astype(np.uint32)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        first[at : at + step] = tokens[h.argmin(1)]
    return owner, mix(seeds ^ mix(first))


def key_of(docs: DataFrame, text: str, key: str) -> Column:
    """The key as it is joined and returned: a long, or a string."""
    kind = "string" if dict(docs.dtypes)[key] == "string" else "long"
    return F.coalesce(docs[key].cast(kind), F.xxhash64(docs[text]).cast(kind))


def word_hashes(text: str | Column) -> Column:
    return F.transform(C.words(C.clean(text)), lambda x: F.xxhash64(x))


def lists(column: pa.ChunkedArray | pa.Array) -> Iterator[np.ndarray]:
    values, at = np.asarray(column.values), np.asarray(column.offsets)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield values[a:b]


def signatures(keyed: DataFrame, runs: int) -> DataFrame:
    """k, th, two hashes of the shingle set, its size, its sketch and the nodes of the first level that it comes to."""
    roots = np.arange(1, runs + 1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            tops = mix(roots * _G)
            for batch in batches:
                a, b, n, sk, nodes = [], [], [], [], []
                for w in lists(batch.column("h")):
                    s = shingles(w)
                    a.append(int(mix(s).sum().view(np.int64)) if len(s) else 0)
                    b.append(int(mix(s ^ _G).sum().view(np.int64)) if len(s) else 0)
                    n.append(len(s))
                    sk.append(sketch(s))
                    nodes.append(np.unique(children(s, tops)[1]).view(np.int64) if len(s) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_pydict({"k": batch.column("k"), "th": batch.column("th"), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64()), "sk": pa.array(sk, pa.binary()), "nodes": pa.array(nodes, pa.list_(pa.int64()))})

    kind = dict(keyed.dtypes)["k"]
    return keyed.select("k", "th", word_hashes("t").alias("h")).mapInArrow(C.lean(run), f"k {kind}, th long, a long, b long, n long, sk binary, nodes array<long>")


def descend(keyed: DataFrame, active: DataFrame, reps: DataFrame) -> DataFrame:
    """c, n, parent, node: the children of the nodes of active (c, n, node)."""
    lists_of = active.groupBy("c", "n").agg(F.collect_list("node").alias("nodes"))  # of one class: bounded by runs and levels
    wanted = C.written(lists_of.join(reps, "c"), "wanted", rows=active.count())
    rows = C.with_few(keyed, wanted, ["k", "th"]).dropDuplicates(["c"]).select("c", "n", "nodes", word_hashes("t").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                out = []
                for c, n, nodes, w in zip(batch.column("c").to_pylist(), batch.column("n").to_pylist(), lists(batch.column("nodes")), lists(batch.column("h")), strict=True):
                    owner, child = children(shingles(w), nodes.view(np.uint64))
                    out.append((np.full(len(owner), c), np.full(len(owner), n), nodes[owner], child.view(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=["c", "n", "parent", "node"])

    return rows.mapInArrow(C.lean(run), "c long, n long, parent long, node long")


def sizes_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where("m > 1")


def buckets(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """node, c, n, blocks, block: the classes of every bucket with two or more."""
    total = classes.count()
    reps = classes.select("c", "rep.k", "rep.th")
    rows = classes.select("c", "n", F.explode("nodes").alias("node"))
    done: list[DataFrame] = []
    for level in range(1, DEPTH + 1):
        sizes = C.written(sizes_of(rows), "sizes", rows=total)
        large = sizes.where((F.col("m") > GROUP) | (F.col("s") > SHINGLES))
        blocks = F.greatest(F.ceil(F.col("m") / GROUP), F.ceil(F.col("s") / SHINGLES)).cast("int").alias("blocks")
        split = sizes.where(F.col("m") > GROUP).select("node", "m") if level < DEPTH else None
        if split is None or not split.limit(1).count():
            done.append(rows.join(C.small(sizes.select("node", blocks)), "node"))
            break
        of_split = split.agg(F.sum("m")).first()[0]
        active = C.written(rows.join(C.small(split), "node", "left_semi").distinct(), "active", rows=of_split)
        below = C.written(descend(keyed, active, reps).distinct(), "below", BATCH, of_split)
        most = below.groupBy("parent", "node").agg(F.count("*").alias("x")).groupBy("parent").agg(F.max("x").alias("x"))
        parted = C.written(split.join(most, split["node"] == most["parent"]).where(F.col("x") < DENSE * F.col("m")).select("parent"), "parted", rows=of_split // GROUP)
        stay = sizes.join(C.small(parted), sizes["node"] == parted["parent"], "left_anti").select("node", blocks)
        done.append(rows.join(C.small(stay), "node"))
        rows = C.written(below.join(C.small(parted), "parent", "left_semi").select("c", "n", "node"), "nodes", rows=of_split)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.distinct().withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))


def common(node: int, lists: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of members share a bucket that comes before this one."""
    low = [x[: np.searchsorted(x, node)] for x in lists]
    ids, place, often = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(low)), [len(x) for x in low])
    two = often[place] > 1
    out = np.zeros((len(left), len(right)), np.float32)
    owner, place = owner[two], (np.cumsum(often > 1) - 1)[place[two]]
    wide = 2048
    for at in range(0, int((often > 1).sum()), wide):
        some = (place >= at) & (place < at + wide)
        m = np.zeros((len(low), wide), np.float32)
        m[owner[some], place[some] - at] = 1
        out += m[left] @ m[right].T
    return out > 0


def sketches(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["sk"]), np.uint8).reshape(len(rows), -1)


def own_pairs(rows: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members on the left and on the right, and which pairs of them this bucket compares: sizes and sketches fit, no bucket before has them. rows: one of each member."""
    node, p, q = rows[["node", "p", "q"]].to_numpy()[0]
    n, block, lists, sk = rows["n"].to_numpy(), rows["block"].to_numpy(), list(rows["near"]), sketches(rows)
    left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
    small, large = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
    mine = small >= threshold * large - 1e-9
    mine &= np.triu(np.ones(mine.shape, bool), 1) if p == q else left[:, None] != right[None, :]
    if mine.any():
        mine &= alike(sk[left], sk[right], threshold)
    if mine.any():
        mine &= ~common(node, lists, left, right)
    return left, right, mine


def whole_groups(batches: Iterator[pd.DataFrame], done: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Applies done to the rows of whole groups (node, p, q) of sorted batches; the last group of a batch waits for more."""
    rest: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[["node", "p", "q"]].to_numpy()
        if rest and (keys[0] != last).any():
            yield done(pd.concat(rest, ignore_index=True))
            rest = []
        last = keys[-1]
        first = int(np.flatnonzero((keys != last).any(1))[-1]) + 1 if (keys != last).any() else 0
        if first:
            yield done(pd.concat([*rest, batch.iloc[:first]], ignore_index=True))
            rest = []
        rest.append(batch.iloc[first:])
    if rest:
        yield done(pd.concat(rest, ignore_index=True))


def cuts(rows: pd.DataFrame) -> list[tuple[int, int]]:
    """Where the groups of (node, p, q) begin and end."""
    keys = rows[["node", "p", "q"]].to_numpy()
    at = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
    ends = [0, *at.tolist(), len(rows)]
    return list(zip(ends[:-1], ends[1:], strict=True))


def needed(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The rows of members that have a pair which their bucket compares."""
    keep = np.zeros(len(rows), bool)
    n, keys, sk = rows["n"].to_numpy(), rows[["node", "p", "q"]].to_numpy(), sketches(rows)
    near, ends = list(rows["near"]), np.array(cuts(rows))
    two = ends[(ends[:, 1] - ends[:, 0] == 2) & (keys[ends[:, 0], 1] == keys[ends[:, 0], 2]), 0]  # most groups
    x, y = sk[two], sk[two + 1]
    fits = ((x == y) & (x != 0)).sum(1) >= (threshold - SLACK) * ((x | y) != 0).sum(1)
    for a in two[fits & (np.minimum(n[two], n[two + 1]) >= threshold * np.maximum(n[two], n[two + 1]) - 1e-9)].tolist():
        low = [v[: np.searchsorted(v, keys[a, 0])] for v in near[a : a + 2]]
        keep[a : a + 2] = not len(np.intersect1d(*low, assume_unique=True))
    done = set(two.tolist())
    for a, b in ends.tolist():
        if b - a > 1 and a not in done:
            left, right, mine = own_pairs(rows.iloc[a:b], threshold)
            keep[a + left[mine.any(1)]] = True
            keep[a + right[mine.any(0)]] = True
    return rows[keep]


def compare(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of the pairs that a bucket compares: (c, -1, weight of its links), and edges of a spanning forest with n 0.

    rows: pieces of the texts' words (c, piece, h) of one group.
    """
    rows = rows.sort_values(["c", "piece"], kind="stable").drop_duplicates(["c", "piece"])
    c = rows["c"].to_numpy()
    start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    one = rows.iloc[start]
    left, right, mine = own_pairs(one, threshold)
    none = pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
    if not mine.any():
        return none
    with np.errstate(over="ignore"):
        each = [shingles(np.asarray(h, np.int64)) for h in rows["h"]]
        ends = [*start[1:].tolist(), len(each)]
        sets = [each[a] if b - a == 1 else np.unique(np.concatenate(each[a:b])) for a, b in zip(start.tolist(), ends, strict=True)]
    del each
    ids, w = one["c"].to_numpy(), one["w"].to_numpy()
    size = np.array([len(s) for s in sets], np.int64)
    x, y = np.nonzero(mine)
    if len(x) <= 4 * len(sets):
        both = np.array([len(np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True)) for i, j in zip(x, y, strict=True)], np.float64)
    else:
        both = products(sets, left, right)[x, y].astype(np.float64)
    x, y = left[x], right[y]
    keep = both >= threshold * (size[x] + size[y] - both) - 1e-6
    x, y = x[keep], y[keep]
    if not len(x):
        return none
    links = (np.bincount(x, w[y], len(ids)) + np.bincount(y, w[x], len(ids))).astype(np.int64)
    some = np.flatnonzero(links)
    tree = forest(x, y, len(ids))
    out = pd.DataFrame({"a": ids[some], "b": -1, "n": links[some]})
    return pd.concat([out, pd.DataFrame({"a": [ids[i] for i, _ in tree], "b": [ids[j] for _, j in tree], "n": 0})]).astype({"a": "int64", "b": "int64", "n": "int64"})


def products(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets on the left with those on the right."""
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = often[token] > 1
    owner, token = owner[shared], (np.cumsum(often > 1) - 1)[token[shared]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    out = np.zeros((len(left), len(right)), np.float32)
    wide = 2048
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, wide):
        a, b = np.searchsorted(token, [at, at + wide])
        m = np.zeros((len(sets), wide), np.float32)
        m[owner[a:b], token[a:b] - at] = 1
        out += m[left] @ m[right].T
    return out


def found_links(keyed: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """a, b, n: for each class its links (b = -1, n of them), and edges of a spanning forest of the links (n = 0)."""
    mates = C.written(buckets(keyed, classes), "buckets", rows=classes.count())
    near = mates.groupBy("c").agg(F.sort_array(F.collect_set("node")).alias("near"))  # of one class: bounded by runs and levels
    rows = mates.join(near.join(classes.select("c", "sk"), "c"), "c").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "c", "n", "block", "near", "sk")
    kind = "node long, p int, q int, c long, n long, block int, near array<long>, sk binary"
    some = rows.repartition("node", "p", "q").sortWithinPartitions("node", "p", "q").mapInPandas(C.lean(lambda b: whole_groups(b, lambda x: needed(x, threshold))), kind)
    some = C.written(some.join(classes.select("c", "w", "rep.k", "rep.th"), "c"), "compared")
    texts = C.with_few(keyed, some, ["k", "th"]).select(*some.columns, word_hashes("t").alias("h"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("h") - 1, F.lit(0)), F.lit(PIECE)))
    texts = texts.drop("k", "th").withColumn("piece", at).withColumn("h", F.expr(f"slice(h, piece + 1, {PIECE + WORDS - 1})")).where(f"piece = 0 OR size(h) >= {WORDS}")
    links = texts.repartition("node", "p", "q").sortWithinPartitions("node", "p", "q").mapInPandas(
        C.lean(lambda b: whole_groups(b, lambda x: pd.concat([compare(x.iloc[i:j], threshold) for i, j in cuts(x)]))), "a long, b long, n long"
    )
    return C.written(links, "links", BATCH)


def joined(docs: DataFrame, text: str, key: str, threshold: float, runs: int) -> DataFrame:
    """k, th, class_id, n_links, component_id, kept for every row of docs."""
    C.ship(docs.sparkSession)
    keyed = docs.select(key_of(docs, text, key).alias("k"), F.xxhash64(C.clean(docs[text])).alias("th"), C.clean(docs[text]).alias("t"))
    signed = C.written(signatures(keyed, runs), "signatures", BATCH, rows=2 * docs.count())
    classes = signed.where("n > 0").groupBy("a", "b", "n").agg(F.min(F.struct("k", "th")).alias("rep"), F.count("*").alias("w"), F.first("sk").alias("sk"), F.first("nodes").alias("nodes"))
    total = signed.count()
    classes = C.written(classes.withColumn("c", F.monotonically_increasing_id()), "classes", rows=total)  # written, so that c stays
    links = found_links(keyed, classes, threshold)
    count = links.where("n > 0").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("links"))
    groups = C.components(links.where("n = 0")).select(F.col("id").alias("c"), "component")
    firsts = groups.join(classes.select("c", "rep"), "c").groupBy("component").agg(F.min("rep").alias("top"))
    tops = groups.join(C.small(firsts), "component").select("c", "top")
    known = classes.select("a", "b", "n", "c", "rep", "w").join(count, "c", "left").join(tops, "c", "left")
    known = known.select("a", "b", "n", "w", F.col("rep.k").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("top", "rep").alias("top"))
    own = F.struct("k", "th")
    # Texts without shingles are classes of their own and take no part in the join: they would all have the same key.
    some = C.spread(signed.where("n > 0").select("k", "th", "a", "b", "n"), C.written(known, "known", rows=total), ["a", "b", "n"], "w", total)
    some = some.select("k", "th", "class_id", F.col("links").alias("n_links"), F.col("top.k").alias("component_id"), (F.col("top") == own).alias("kept"))
    blank = signed.where("n = 0").select("k", "th", F.col("k").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"), F.lit(True).alias("kept"))
    return some.unionByName(blank)


def jaccard_join(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, runs: int = RUNS) -> DataFrame:
    """For every row of docs: key, class_id, n_links (other documents with a Jaccard similarity of threshold or more), component_id, kept."""
    return joined(docs, text, key, threshold, runs).drop("th").withColumnRenamed("k", key)


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", **how: float) -> DataFrame:
    """One row of each component: that with the smallest key (of equal keys, the smallest hash of the text). All columns of docs."""
    found = joined(docs, text, key, how.get("threshold", THRESHOLD), how.get("runs", RUNS))
    kept = C.written(found.where("kept").groupBy("k", "th").agg(F.count("*").alias("rows")), "kept", rows=docs.count())
    names = [f"c{i}" for i in range(len(docs.columns))]
    out = docs.select(*(docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)), key_of(docs, text, key).alias("k"), F.xxhash64(C.clean(docs[text])).alias("th"))
    out = out.join(C.small(kept.select("k", "th")), ["k", "th"], "left_semi")
    if kept.where("rows > 1").limit(1).count():  # repeated rows
        out = out.dropDuplicates(["k", "th"])
    return out.select(*names).toDF(*docs.columns)
